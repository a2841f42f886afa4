"""What columns hold."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .cleaning import is_number


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n_null, n_distinct, min_value, max_value, mean_value, mean_length`` in one pass."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    agg, rows = [], []
    for i, f in enumerate(fields):
        c, num = F.col(f.name), is_number(f)
        agg += [F.count_if(c.isNull()).alias(f"z{i}"), F.count_distinct(c).alias(f"d{i}")]
        agg += [(x(c.cast("double")) if num else F.lit(None).cast("double")).alias(f"{k}{i}") for k, x in (("a", F.min), ("b", F.max), ("m", F.avg))]
        agg += [(F.lit(None).cast("double") if num else F.avg(F.length(c.cast("string")))).alias(f"l{i}")]
        names = (("n_null", "z"), ("n_distinct", "d"), ("min_value", "a"), ("max_value", "b"), ("mean_value", "m"), ("mean_length", "l"))
        rows.append(F.struct(F.lit(f.name).alias("column"), *(F.col(f"{k}{i}").alias(n) for n, k in names)))
    return df.agg(*agg).select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, columns: list[str], k: int = 6) -> DataFrame:
    """``column, value, n, rank``: the k most frequent values of each column; equal counts by value."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def describe_schema(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, kind, n_distinct, warning``: binary, integer, float, coded, text or string columns.

    Text is coded if four fifths of its values read as numbers, there are at most 50 and they are short; it
    is free text if values have 25 characters on average.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    agg, rows = [], []
    for i, f in enumerate(fields):
        c = F.col(f.name)
        t = c.cast("string")
        agg.append(F.count_distinct(c).alias(f"d{i}"))
        if is_number(f):
            agg.append(F.coalesce(F.bool_and(c.cast("double") == F.floor(c.cast("double"))), F.lit(False)).alias(f"w{i}"))
            agg.append(F.coalesce(F.bool_and(c.cast("double").isin(0.0, 1.0)), F.lit(False)).alias(f"b{i}"))
            kind = F.when(F.col(f"b{i}") & (F.col(f"d{i}") == 2), "binary").when(F.col(f"w{i}"), "integer").otherwise("float")
            warning = F.when(F.col(f"d{i}") < 2, "fewer than two levels").when(F.col(f"d{i}") > 30, "continuous")
        else:
            agg.append(F.avg(F.when(t.isNotNull(), t.try_cast("double").isNotNull().cast("double"))).alias(f"w{i}"))
            agg.append(F.avg(F.length(t)).alias(f"b{i}"))
            kind = F.when((F.col(f"w{i}") >= 0.8) & (F.col(f"d{i}") <= 50) & (F.col(f"b{i}") <= 6), "coded").when(F.col(f"b{i}") >= 25, "text").otherwise("string")
            warning = F.when(F.col(f"d{i}") < 2, "fewer than two levels")
        rows.append(F.struct(F.lit(f.name).alias("column"), kind.alias("kind"), F.col(f"d{i}").alias("n_distinct"), warning.alias("warning")))
    return df.agg(*agg).select(F.inline(F.array(*rows)))


def module_stats(df: DataFrame, modules: dict[str, str], most: int = 5) -> DataFrame:
    """``module, column, mean, std, missing``: up to ``most`` columns (by name) of each module."""
    by: dict[str, list[str]] = {}
    for c in sorted(modules):
        if c in df.columns:
            by.setdefault(modules[c], []).append(c)
    chosen = [(m, c) for m, cs in sorted(by.items()) for c in cs[:most]]
    agg = [f(F.col(c).cast("double")).alias(f"{k}{i}") for i, (_, c) in enumerate(chosen) for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    agg += [F.avg(F.col(c).isNull().cast("double")).alias(f"z{i}") for i, (_, c) in enumerate(chosen)]
    rows = [F.struct(F.lit(m).alias("module"), F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"z{i}").alias("missing")) for i, (m, c) in enumerate(chosen)]
    return df.agg(*agg).select(F.inline(F.array(*rows)))


def substantive(df: DataFrame, skip: list[str], most_missing: float = 0.9) -> DataFrame:
    """``column`` of those worth scanning: numbers, or text half of which reads as numbers, at least two
    different values and at most ``most_missing`` missing."""
    cols = [c for c in df.columns if c not in skip]
    agg = []
    for i, c in enumerate(cols):
        num = F.expr(f"try_cast(cast(`{c}` as string) as double)")
        agg += [F.avg(num.isNotNull().cast("double")).alias(f"n{i}"), F.avg(F.col(c).isNull().cast("double")).alias(f"z{i}"), F.count_distinct(c).alias(f"d{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("numeric_share"), F.col(f"z{i}").alias("missing_share"), F.col(f"d{i}").alias("n_distinct"), F.lit(is_number(df.schema[c])).alias("number")) for i, c in enumerate(cols)]
    x = df.agg(*agg).select(F.inline(F.array(*rows)))
    return x.where((F.col("missing_share") <= most_missing) & (F.col("n_distinct") >= 2) & (F.col("number") | (F.col("numeric_share") >= 0.5))).drop("number")
