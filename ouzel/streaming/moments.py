"""Moments of a stream, kept so that correlations and means can be read at any time.

Sums of products add up over batches, so each micro-batch contributes one small row per group.
"""

from __future__ import annotations

import os

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def moments(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group, n, sx, sy, sxx, syy, sxy`` of rows where both values are known."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    known = df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    return known.groupBy(group).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))


def combine(states: DataFrame, group: str) -> DataFrame:
    return states.groupBy(group).agg(*(F.sum(c).alias(c) for c in _SUMS))


def read_out(state: DataFrame, group: str) -> DataFrame:
    """``group, n, mean_x, mean_y, r``."""
    top = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    below = F.sqrt(F.greatest(F.lit(0.0), (F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n"))))
    return state.select(group, "n", (F.col("sx") / F.col("n")).alias("mean_x"), (F.col("sy") / F.col("n")).alias("mean_y"), F.try_divide(top, below).alias("r"))


def keep_moments(stream: DataFrame, group: str, x: str, y: str, place: str, checkpoint: str):
    """Start a query that writes each micro-batch's moments under ``place``; a batch run again replaces its own.

    Read ``spark.read.parquet(place)`` with ``combine`` and ``read_out``.
    """

    def write(batch: DataFrame, number: int) -> None:
        moments(batch, group, x, y).coalesce(1).write.mode("overwrite").parquet(os.path.join(place, f"batch={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, group: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per tumbling window and group; rows later than ``late`` are left out."""
    t = F.col(time).cast("timestamp")
    return stream.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def read_stream(spark: SparkSession, place: str, schema, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(place)
