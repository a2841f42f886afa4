"""Queries about keys that hold many rows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators.skew import heavy_keys, per_key
from ..session import stage, table

FIELDS = ("asin", "reviewerid")


def _stats(spark: SparkSession, d: str, field: str) -> DataFrame:
    return per_key(table(spark, d, "amazon_books_autokd"), field, "review_unix", "review_id", "helpful_votes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = [heavy_keys(stage(_stats(spark, d, f), "stats"), 0.02).select(F.lit(f).alias("field"), "key_value") for f in FIELDS]
    return heavy[0].unionAll(heavy[1])


def p4_key_stats(spark: SparkSession, d: str) -> DataFrame:
    both = [_stats(spark, d, f).withColumn("field", F.lit(f)) for f in FIELDS]
    every = both[0].unionByName(both[1])
    return every.withColumns({c: F.round(c, 6) for c in ("mean_value", "std_value")})


QUERIES = {"p4_found": p4_found, "p4_key_stats": p4_key_stats}

SQL = {
    "p4_found": " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS key_value FROM amazon_books_autokd WHERE regexp_matches({f}, '\\S') GROUP BY {f} HAVING count(*) >= 0.02 * (SELECT count(*) FROM amazon_books_autokd)" for f in FIELDS
    ),
    "p4_key_stats": " UNION ALL ".join(
        f"""SELECT '{f}' AS field, key_value, count(*) AS n_rows, count(v) AS n_values, round(avg(v), 6) AS mean_value, round(stddev_samp(v), 6) AS std_value,
        min(v)::double AS min_value, max(v)::double AS max_value, min(o) AS first_order, max(o) AS last_order, max(gap) AS longest_gap
        FROM (SELECT {f} AS key_value, helpful_votes AS v, review_unix AS o, review_unix - lag(review_unix) OVER (PARTITION BY {f}, review_unix IS NULL ORDER BY review_unix) AS gap FROM amazon_books_autokd)
        GROUP BY key_value"""
        for f in FIELDS
    ),
}
