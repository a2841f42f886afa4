"""Rank statistics from counts of distinct values."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..session import stage


def _ranked(counts: DataFrame) -> DataFrame:
    """``value, ties, mid_rank`` from ``value, ties``.

    Running counts never gather in one task: distinct values are range-partitioned, summed within each
    partition, and shifted by the counts of the partitions before, of which there is one row per partition.
    """
    placed = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    inner = stage(placed.withColumn("upto", F.sum("ties").over(Window.partitionBy("part").orderBy("value"))), "ranks")
    sizes = inner.groupBy("part").agg(F.max("upto").alias("size"))
    offsets = sizes.withColumn("offset", F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("offset", F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("upto") - F.col("ties") + (F.col("ties") + 1).cast("double") / 2
    return inner.join(F.broadcast(offsets), "part").select("value", "ties", rank.alias("mid_rank"))


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """``value``, ``ties`` and ``mid_rank`` (the mean rank of equal values) of each distinct value."""
    return _ranked(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("ties")))


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """``(level, n, rank_sum)`` per level of ``group`` and one row ``(n, tie_sum)``, ``tie_sum`` = sum of t^3 - t.

    Null values and groups aren't counted. The table is read once; all else works on counts of distinct
    values per level.
    """
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    per = stage(known.groupBy(F.col(value).alias("value"), F.col(group).cast("string").alias("level")).agg(F.count("*").alias("m")), "counts")
    ranks = _ranked(per.groupBy("value").agg(F.sum("m").alias("ties")))
    levels = per.join(ranks, "value").groupBy("level").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("mid_rank")).alias("rank_sum"))
    ties = ranks.agg(F.sum("ties").alias("n"), F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie_sum"))
    return levels, ties


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, rho``: Pearson's correlation of the mid-ranks of rows where both are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = stage(known.groupBy("a", "b").agg(F.count("*").alias("m")), "pairs")
    ra = _ranked(pairs.groupBy(F.col("a").alias("value")).agg(F.sum("m").alias("ties"))).select(F.col("value").alias("a"), F.col("mid_rank").alias("x"))
    rb = _ranked(pairs.groupBy(F.col("b").alias("value")).agg(F.sum("m").alias("ties"))).select(F.col("value").alias("b"), F.col("mid_rank").alias("y"))
    s = pairs.join(ra, "a").join(rb, "b").agg(
        F.sum("m").alias("n"), F.expr("sum(m * x)").alias("sx"), F.expr("sum(m * y)").alias("sy"), F.expr("sum(m * x * x)").alias("sxx"), F.expr("sum(m * y * y)").alias("syy"), F.expr("sum(m * x * y)").alias("sxy")
    )
    return s.select("n", F.expr("try_divide(sxy - sx * sy / n, sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))").alias("rho"))
