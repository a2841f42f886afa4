"""Sums of products of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """The matrix of sums of w * a * b over all rows, for every two of ``columns`` (all doubles, no nulls).

    Each task adds up its batches with numpy and passes on one row per entry, which are summed by entry; the
    driver gets one number per entry however many rows and partitions there are.
    """
    k = len(columns)
    src = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            x = b.to_numpy(float)
            total += (x[:, :k] * x[:, k:]).T @ x[:, :k]
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    out = np.zeros((k, k))
    for r in src.mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k (k + 1) / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """For every two columns, over rows where both are known: ``a, b, n, sa, sb, saa, sbb, sab``.

    Columns are taken as doubles less their means, so that large values don't cancel; NaN and infinite
    values count as missing. One pass for the means, one for all pairs.
    """
    value = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in columns}
    num = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).select(*(value[c].alias(c) for c in columns))
    means = num.agg(*(F.avg(c).alias(c) for c in columns)).first()
    k = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        centre = np.array([means[c] or 0.0 for c in columns])
        for b in batches:
            x = b.to_numpy(float) - centre
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            p += x.T @ x
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sa": s[i, j], "sb": s[j, i], "saa": q[i, j], "sbb": q[j, i], "sab": p[i, j]})

    sums = num.mapInPandas(run, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    names = F.array(*map(F.lit, columns))
    return sums.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.col("n").cast("long").alias("n"), "sa", "sb", "saa", "sbb", "sab")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, n, r``: Pearson's correlation of every two columns over rows where both are known."""
    top = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    below = F.sqrt((F.col("saa") - F.col("sa") ** 2 / F.col("n")) * (F.col("sbb") - F.col("sb") ** 2 / F.col("n")))
    return pair_sums(df, columns).where("n > 1").select("a", "b", "n", F.try_divide(top, below).alias("r"))
