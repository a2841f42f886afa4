"""Compares a query's rows with those its SQL gives in DuckDB."""

import datetime
import math
import os

import duckdb
import numpy as np


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([normal(x) for x in v])
    if isinstance(v, dict):
        return str({k: normal(x) for k, x in sorted(v.items())})
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(place):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(place)):
        path = f"{place}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def assert_same(df, c, sql):
    cols = sorted(df.columns)
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(str([normal(r[names.index(k)]) for k in cols]) for r in cur.fetchall())
    got = sorted(str([normal(v) for v in r]) for r in df.select(*cols).collect())
    assert got == want
