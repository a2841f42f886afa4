"""Cleaning of wide tables."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def recode_missing(df: DataFrame, codes: dict[str, list[float]]) -> DataFrame:
    """The given codes of each column as null."""
    return df.withColumns({c: F.when(~F.col(c).isin(v), F.col(c)) for c, v in codes.items()})


def negative_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in columns})


def numeric_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, share``: the share of all rows that read as numbers."""
    one = df.agg(*(F.avg(F.expr(f"case when try_cast(`{c}` as double) is null then 0D else 1D end")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "share")


def to_numbers(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Columns of which more than ``least`` of the rows read as numbers, as doubles."""
    good = {r.column for r in numeric_share(df, columns).collect() if r.share > least}  # a row per column
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns if c in good})


def derive_key(df: DataFrame, parts: list[str], name: str) -> DataFrame:
    """A key of trimmed parts; null if one is missing."""
    joined = F.concat_ws("_", *(F.trim(F.col(p).cast("string")) for p in parts))
    known = F.lit(True)
    for p in parts:
        known = known & F.col(p).isNotNull()
    return df.withColumn(name, F.when(known, joined))


def select_columns(columns: list[str], keep: list[str], drop: list[str]) -> list[str]:
    """Columns that match a pattern to keep (if any are given) and none to drop, in their order."""
    return [c for c in columns if (not keep or any(re.search(k, c) for k in keep)) and not any(re.search(k, c) for k in drop)]


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, missing_share, n_distinct`` of all columns in one pass."""
    agg = [F.avg(F.col(c).isNull().cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)]
    agg += [F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)]
    one = df.agg(*agg)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing_share"), F.col(f"d_{i}").alias("n_distinct")) for i, c in enumerate(columns)))
    return one.select(F.inline(rows))


def low_information(stats: DataFrame, most_missing: float = 0.95, least_distinct: int = 2) -> DataFrame:
    return stats.where((F.col("missing_share") > most_missing) | (F.col("n_distinct") < least_distinct))


def thin(stats: DataFrame, required: list[str], most_missing: float = 0.85, cap: int | None = None) -> DataFrame:
    """Columns to keep: required ones first, then by missing share, distinct values (many first) and name."""
    must = F.col("column").isin(required) if required else F.lit(False)
    kept = stats.withColumn("required", must).where(F.col("required") | ((F.col("missing_share") <= most_missing) & (F.col("n_distinct") > 1)))
    order = [F.desc("required"), F.asc("missing_share"), F.desc("n_distinct"), F.asc("column")]
    return kept.orderBy(*order) if cap is None else kept.orderBy(*order).limit(cap)


def small_integers_to_text(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """Whole-numbered columns of at most ``most`` different values as text levels."""
    agg = []
    for i, c in enumerate(columns):
        agg += [F.count_distinct(c).alias(f"d{i}"), F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(False)).alias(f"w{i}")]
    r = df.agg(*agg).first()
    return df.withColumns({c: F.col(c).cast("bigint").cast("string") for i, c in enumerate(columns) if r[f"d{i}"] <= most and r[f"w{i}"]})


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, without sorting a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest if c in rest and c not in keys))


def missing_rates(df: DataFrame, columns: list[str], least: float = -1.0) -> DataFrame:
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "missing_rate").where(F.col("missing_rate") > least)


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType,))
