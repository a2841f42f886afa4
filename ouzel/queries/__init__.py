"""All queries of the library's core and, where SQL can say it, their SQL."""

from . import cleaning, findings, pipeline, skew, statistics

_PARTS = (pipeline, cleaning, statistics, findings, skew)
QUERIES = {k: q for m in _PARTS for k, q in m.QUERIES.items()}
SQL = {k: q for m in _PARTS for k, q in m.SQL.items()}
