"""Top N rows of every group behind a histogram threshold."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


#: The greatest ``n`` at which Spark cuts groups before it shuffles them (``spark.sql.optimizer.windowGroupLimitThreshold``).
LIMITED = 1000
#: Parts of a group that are cut one by one where ``n`` is greater.
PARTS = 256


def score_bucket(score: Column) -> Column:
    """A non-decreasing map of numbers to few integers: eight buckets to a doubling of 1 + |score|."""
    x = score.cast("double")
    bound = F.least(F.abs(x), F.lit(1.7e308))
    return (F.signum(x) * F.floor(8 * F.log2(1 + bound))).cast("int")


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, keep: list[str] | None = None) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; equal scores go to smaller ``ties``.

    A histogram of scores per group, combined before it is shuffled, gives the highest bucket above
    which a group still has ``n`` rows (or its lowest bucket, if it has fewer). Rows below it can't be
    among the first n. The rest is ranked exactly; the rank filter lets each task pass on at most n rows
    of a group, so that neither large groups nor masses of equal scores gather in one task. Where ``n`` is too
    large for Spark to do so, groups are first cut to n rows in each of ``PARTS`` parts by hash, which hold all of the first n.

    Returns the ``group``, ``score``, ``ties`` and ``keep`` columns and ``rank``. Rows with a null or NaN
    score aren't ranked. Null group values form a group like any other. Repeated rows count as rows; rows
    alike in score and all ties are interchangeable. An empty table gives none. Other columns are left out,
    whatever their names.
    """
    if n < 1:
        raise ValueError("n must be positive")
    columns = list(dict.fromkeys([*group, score, *ties, *(keep or [])]))
    if clash := {"rank", "_bucket", "_n", "_least", "_part"} & set(columns):
        raise ValueError(f"rename the columns {sorted(clash)}")
    rows = df.select(*columns).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).withColumn("_bucket", score_bucket(F.col(score)))
    histogram = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    needed = histogram.withColumn("_n", F.coalesce(F.sum("_n").over(above), F.lit(0))).where(F.col("_n") < n)
    least = needed.groupBy(*group).agg(F.min("_bucket").alias("_least"))
    least = least.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_least")
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    survivors = rows.join(least, same & (F.col("_bucket") >= F.col("_least"))).select(*columns)
    best = [F.desc(score), *(F.asc_nulls_last(t) for t in ties)]
    if n > LIMITED:
        parts = survivors.withColumn("_part", F.pmod(F.xxhash64(score, *ties), F.lit(PARTS)))
        survivors = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*best))).where(F.col("rank") <= n).select(*columns)
    order = Window.partitionBy(*group).orderBy(*best)
    return survivors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
