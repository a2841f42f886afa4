"""Exact percentiles per group by bisection over counts that can be combined.

The state of a table is its value counts per group. States of days or partitions are added up. For each
group and percentile an interval that holds the wanted rank is kept. A pass counts the rows below
evenly spaced midpoints of the interval (``SECTIONS`` of them, which does the work of six plain
bisections at a time), picks the section with the rank and narrows the interval to the least and
greatest value seen there. Only counts within open intervals go into the next pass.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..session import stage

SECTIONS = 64
#: Stands for infinity while sections are computed.
EDGE = 1.7976931348623157e308


def value_counts(df: DataFrame, group: list[str], value: str, resolution: float = 0.0) -> DataFrame:
    """The state of ``df``: ``group`` columns, ``value`` double, ``n``.

    Null and NaN values aren't counted; infinite ones are. With a ``resolution`` > 0, values are rounded
    to its multiples, which bounds the size of the state; a percentile is then off by at most half of it.
    """
    x = F.col(value).cast("double")
    if resolution > 0:
        x = F.when(F.abs(x) == float("inf"), x).otherwise(F.round(x / resolution) * resolution)
    return df.select(*group, (x + F.lit(0.0)).alias("value")).where("value is not null and not isnan(value)").groupBy(*group, "value").agg(F.count("*").alias("n"))


def combine(states: list[DataFrame], group: list[str]) -> DataFrame:
    """One state from those of several days or partitions."""
    return reduce(DataFrame.unionByName, states).groupBy(*group, "value").agg(F.sum("n").alias("n"))


def _same(group: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"s.{g}").eqNullSafe(F.col(f"i.{g}")) for g in group])


def percentiles(state: DataFrame, group: list[str], shares: list[float], tolerance: float = 0.0, resolution: float = 0.0) -> DataFrame:
    """``group`` columns, ``percentile``, ``n_rows``, ``value``, ``error_bound`` from a state.

    ``value`` is the least value v such that at least ``percentile`` of the group's rows are <= v. With a
    ``tolerance`` > 0, passes end once an interval is that narrow, and the true value lies within
    ``error_bound`` below ``value``; with 0 it is exact. A state's ``resolution`` has to be given here too: finite
    values are then off by half of it besides, to either side, which ``error_bound`` holds. Null group values form a group. Groups without any
    counted value and empty tables give no rows.
    """
    if not all(0 <= p <= 1 for p in shares):
        raise ValueError("shares lie between 0 and 1")
    if clash := {"value", "n", "percentile", "lo", "hi", "rank", "n_rows", "below"} & set(group):
        raise ValueError(f"rename the columns {sorted(clash)}")
    counts = stage(state.select(*group, F.greatest(F.least("value", F.lit(EDGE)), F.lit(-EDGE)).alias("value"), "n"), "counts")
    first = counts.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n_rows"))
    first = first.withColumn("percentile", F.explode(F.array(*(F.lit(float(p)) for p in dict.fromkeys(shares)))))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("percentile") * F.col("n_rows"), 9))).cast("long")
    intervals = stage(first.withColumn("rank", rank).withColumn("below", F.lit(0).cast("long")), "intervals")
    shape = [*group, "percentile", "n_rows", "rank", "below", "lo", "hi"]
    open_, closed = F.col("hi") - F.col("lo") > tolerance, []
    while True:
        closed.append(intervals.where(~open_).select(*shape))
        active = intervals.where(open_)
        if active.isEmpty():
            break
        held = [c for c in counts.columns if c in (*group, "percentile", "value", "n")]
        in_reach = _same([*group, *(["percentile"] if "percentile" in held else [])]) & F.col("s.value").between(F.col("i.lo"), F.col("i.hi"))
        joined = counts.select(*held).alias("s").join(active.alias("i"), in_reach)
        counts = stage(joined.select(*(F.col(f"i.{c}").alias(c) for c in shape), "s.value", "s.n"), "counts")
        width = F.col("hi") / SECTIONS - F.col("lo") / SECTIONS  # divided first: hi - lo may overflow
        section = F.when(F.col("value") >= F.col("hi"), SECTIONS).otherwise(F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / width * 2), F.lit(SECTIONS - 1)))
        parts = counts.withColumn("section", section.cast("int")).groupBy(*shape, "section").agg(F.sum("n").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = Window.partitionBy(*group, "percentile").orderBy("section")
        parts = parts.withColumn("reached", F.col("below") + F.sum("m").over(upto)).where(F.col("reached") >= F.col("rank"))
        pick = parts.groupBy(*group, "percentile", "n_rows", "rank").agg(F.min_by(F.struct(F.expr("reached - m").alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi")), "section").alias("x"))
        intervals = stage(pick.select(*group, "percentile", "n_rows", "rank", "x.*"), "intervals").select(*shape)
    done = reduce(DataFrame.unionAll, closed)
    value = F.when(F.col("hi") >= EDGE, float("inf")).when(F.col("hi") <= -EDGE, float("-inf")).otherwise(F.col("hi"))
    return done.select(*group, "percentile", "n_rows", value.alias("value"), (F.col("hi") - F.col("lo") + F.when(F.abs("hi") < EDGE, resolution / 2).otherwise(0.0)).alias("error_bound"))
