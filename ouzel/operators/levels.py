"""Levels of categorical columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

MIN_LEVEL_ROWS = 30
MAX_LEVELS = 80
OTHER = "Other"


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """``level`` (as text) and ``n``, without null."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))


def kept_levels(df: DataFrame, column: str, least: int = MIN_LEVEL_ROWS, most: int = MAX_LEVELS - 1) -> tuple[list[str], list[str], int]:
    """Levels kept, the first 200 names of levels pooled (for reports; all are pooled) and the pooled rows.

    At most ``most`` + 201 rows are collected, and a count.
    """
    counts = level_counts(df, column)
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "level").limit(most + 1).collect()
    kept = [r.level for r in top[:most]]
    rest = counts.where(~F.col("level").isin(kept)) if kept else counts
    if not kept:
        return kept, [], 0
    names = [r.level for r in rest.select("level").orderBy("level").limit(200).collect()]
    return kept, names, int(rest.agg(F.sum("n").alias("n")).first().n or 0)


def collapse_rare(df: DataFrame, column: str, least: int = MIN_LEVEL_ROWS, most: int = MAX_LEVELS - 1) -> tuple[DataFrame, list[str]]:
    """Pool levels with fewer than ``least`` rows, and those after the ``most`` most frequent, as "Other".

    If what is pooled has fewer than ``least`` rows it becomes null. Nothing changes when no level or every
    level qualifies. Equal counts go by the level's text. Returns the table and the pooled levels.
    """
    kept, pooled, n = kept_levels(df, column, least, most)
    if not kept or not pooled:
        return df, []
    text = F.col(column).cast("string")
    rest = F.lit(OTHER) if n >= least else F.lit(None).cast("string")
    return df.withColumn(column, F.when(text.isNull(), None).when(text.isin(kept), text).otherwise(rest)), pooled


def collapse_rare_join(df: DataFrame, column: str, least: int = MIN_LEVEL_ROWS, most: int = MAX_LEVELS - 1) -> DataFrame:
    """The same as one lazy plan: counts are ranked and joined back (by broadcast, ``most`` rows)."""
    counts = level_counts(df, column)
    ranked = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "level").limit(most).select(F.col("level").alias("_kept"))
    totals = counts.join(F.broadcast(ranked), F.col("level") == F.col("_kept"), "left").agg(
        F.sum(F.when(F.col("_kept").isNull(), F.col("n"))).alias("_pooled"), F.count("_kept").alias("_n_kept")
    )
    text = F.col(column).cast("string")
    x = df.join(F.broadcast(ranked), text == F.col("_kept"), "left").join(F.broadcast(totals))
    new = F.when(text.isNull() | F.col("_kept").isNotNull() | (F.col("_n_kept") == 0), text).when(F.col("_pooled") >= least, OTHER)
    return x.withColumn(column, new).drop("_kept", "_pooled", "_n_kept")


def stratified_take(df: DataFrame, stratum: str, key: str, share: float, seed: int = 0, least: int = 1) -> DataFrame:
    """The first ``ceil(share * n)`` (at least ``least``) rows of each stratum in the order of a hash of ``key``.

    The order is the same whatever the partitions. Null strata are left out. Ranks come from hash buckets,
    so that no stratum is sorted in one task: buckets below the cut are taken whole, the bucket of the cut
    is ranked.
    """
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    x = df.where(F.col(stratum).isNotNull()).withColumns({"_h": h, "_b": F.shiftrightunsigned(h, 52).cast("int")})
    counts = x.groupBy(stratum, "_b").agg(F.count("*").alias("_m"))
    by = Window.partitionBy(stratum)
    cut = counts.withColumns({"_all": F.sum("_m").over(by), "_before": F.sum("_m").over(by.orderBy("_b")) - F.col("_m")})
    cut = cut.withColumn("_want", F.least(F.col("_all"), F.greatest(F.lit(least), F.ceil(F.round(F.col("_all") * share, 9)))))
    cut = cut.where("_before < _want").select(stratum, "_b", "_before", "_want", (F.col("_before") + F.col("_m") > F.col("_want")).alias("_partly"))
    joined = x.join(cut, [stratum, "_b"])
    rank = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))
    part = joined.where("_partly").withColumn("_r", rank).where("_before + _r <= _want")
    return joined.where("not _partly").select(*df.columns).unionByName(part.select(*df.columns))


def split(df: DataFrame, key: str, share: float = 0.7, stratum: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts, the first with ``share`` of the rows, by a hash of ``key`` (within each stratum, if given).

    A row's side depends on its own key only, so both parts are plain filters of the table; sizes are met
    up to the spread of the hash. Null strata are left out, as grouping drops them.
    """
    x = df if stratum is None else df.where(F.col(stratum).isNotNull())
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1_000_000))
    first = u < int(share * 1_000_000)
    return x.where(first), x.where(~first)
