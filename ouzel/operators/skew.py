"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..session import stage

_STATE = "k string, n long, n_values long, total double, m2 double, least double, most double, first long, last long, gap long, n_ordered long, edge boolean"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States of the keys of one sorted partition; keys at its ends are marked, as others may hold more of them."""
    pending: pd.DataFrame | None = None
    first_key = True
    for b in batches:
        if not len(b):
            continue
        got = _states(b)
        if pending is not None:
            got = _merge(pd.concat([pending, got], ignore_index=True))
        if len(got) > 1:
            out, pending = got.iloc[:-1].copy(), got.iloc[-1:]
            if first_key:
                out.loc[out.index[0], "edge"] = True
                first_key = False
            yield out
        else:
            pending = got
    if pending is not None:
        yield pending.assign(edge=True)


def _states(b: pd.DataFrame) -> pd.DataFrame:
    # None is a key like any other and comes first.
    codes = (b["k"].ne(b["k"].shift()) & ~(b["k"].isna() & b["k"].shift().isna())).to_numpy()
    codes[0] = True
    starts = np.nonzero(codes)[0]
    n = np.diff(np.append(starts, len(b)))
    v = b["v"].to_numpy(float)
    has = ~np.isnan(v)
    m, s = np.add.reduceat(has.astype(np.int64), starts), np.add.reduceat(np.where(has, v, 0.0), starts)
    mean = s / np.maximum(m, 1)
    dev = np.where(has, v - np.repeat(mean, n), 0.0)
    o = b["o"].to_numpy(float)
    known = ~np.isnan(o)
    step = np.zeros(len(b))
    step[1:] = np.where(known[1:] & known[:-1], o[1:] - o[:-1], 0)
    step[starts] = 0
    return pd.DataFrame({
        "k": b["k"].to_numpy()[starts], "n": n, "n_values": m, "total": s, "m2": np.add.reduceat(dev * dev, starts),
        "least": np.minimum.reduceat(np.where(has, v, np.inf), starts), "most": np.maximum.reduceat(np.where(has, v, -np.inf), starts),
        "first": np.minimum.reduceat(np.where(known, o, np.inf), starts), "last": np.maximum.reduceat(np.where(known, o, -np.inf), starts),
        "gap": np.maximum.reduceat(step, starts).astype(np.int64), "n_ordered": np.add.reduceat(known.astype(np.int64), starts), "edge": False,
    }).replace([np.inf, -np.inf], np.nan).astype({"first": "Int64", "last": "Int64"})


def _merge(s: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring states of one key as one: only the second and a first that ended the batch before can be."""
    a, b = s.iloc[0], s.iloc[1]
    if not (a["k"] == b["k"] or (pd.isna(a["k"]) and pd.isna(b["k"]))):
        return s
    n, m = a["n"] + b["n"], a["n_values"] + b["n_values"]
    m2 = a["m2"] + b["m2"]
    if a["n_values"] and b["n_values"]:
        m2 += (b["total"] / b["n_values"] - a["total"] / a["n_values"]) ** 2 * a["n_values"] * b["n_values"] / m
    across = 0 if pd.isna(a["last"]) or pd.isna(b["first"]) else b["first"] - a["last"]
    one = pd.DataFrame([{
        "k": a["k"], "n": n, "n_values": m, "total": a["total"] + b["total"], "m2": m2, "least": np.fmin(a["least"], b["least"]), "most": np.fmax(a["most"], b["most"]),
        "first": a["first"] if not pd.isna(a["first"]) else b["first"], "last": b["last"] if not pd.isna(b["last"]) else a["last"],
        "gap": max(a["gap"], b["gap"], across), "n_ordered": a["n_ordered"] + b["n_ordered"], "edge": bool(a["edge"] or b["edge"]),
    }]).astype({"first": "Int64", "last": "Int64"})
    return pd.concat([one, s.iloc[2:]], ignore_index=True)


def per_key(df: DataFrame, key: str, order: str, tie: str, value: str, partitions: int | None = None) -> DataFrame:
    """Statistics of ``value`` and of the sequence ``order`` for each ``key``, without stragglers.

    Rows are range-partitioned on (key, order, tie) at quantiles sampled by Spark, so a heavy key is cut
    along its order and spread over as many partitions as its rows need. Each partition is sorted and
    folded into one state per key, in one stream with constant memory. Only the first and last key of a
    partition can go on elsewhere: these boundary states, at most two per partition, are stitched in order.

    Returns ``key_value``, ``n_rows``, ``n_values``, ``mean_value``, ``std_value`` (sample), ``min_value``,
    ``max_value``, ``first_order``, ``last_order`` and ``longest_gap`` (between consecutive rows with a known
    order; null below two). ``order`` is an integer or date-like number; null orders count as rows only.
    A null key is a key; blank keys stay as they are. NaN values count as missing. Repeated rows count.
    ``tie`` spreads rows of one key and order. Empty tables give no rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.col(tie).alias("t"), F.col(value).cast("double").alias("v"))
    spread = rows.repartitionByRange(n, "k", "o", "t").sortWithinPartitions("k", "o", "t").select("k", "o", "v")
    states = stage(spread.mapInPandas(_fold, _STATE), "key-states")
    parts = F.array_sort(F.collect_list(F.when(F.col("n_ordered") > 0, F.struct("first", "last"))))
    between = F.array_max(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i + 1)["first"] - F.element_at("s", i)["last"]))
    stitched = (
        states.where("edge").groupBy("k")
        .agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
             F.collect_list(F.when(F.col("n_values") > 0, F.struct(F.col("n_values").cast("double").alias("n"), (F.col("total") / F.col("n_values")).alias("mean"), F.col("m2").alias("m2")))).alias("moments"),
             F.min("least").alias("least"), F.max("most").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"),
             F.max("gap").alias("gap"), F.sum("n_ordered").alias("n_ordered"), parts.alias("s"))
        .withColumn("m2", F.aggregate("moments", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), _merged)["m2"])
        .withColumn("gap", F.when(F.size("s") > 1, F.greatest("gap", between)).otherwise(F.col("gap")))
    )
    cols = ["k", "n", "n_values", "total", "m2", "least", "most", "first", "last", "gap", "n_ordered"]
    every = states.where("not edge").select(*cols).unionByName(stitched.select(*cols))
    return every.select(
        F.col("k").alias("key_value"), F.col("n").alias("n_rows"), "n_values",
        F.try_divide(F.col("total"), F.col("n_values")).alias("mean_value"),
        F.when(F.col("n_values") > 1, F.sqrt(F.col("m2") / (F.col("n_values") - 1))).alias("std_value"),
        F.col("least").alias("min_value"), F.col("most").alias("max_value"), F.col("first").alias("first_order"), F.col("last").alias("last_order"),
        F.when(F.col("n_ordered") > 1, F.col("gap")).alias("longest_gap"),
    )


def _merged(a: Column, b: Column) -> Column:
    """Both states' rows, mean and squares about it; differences of means don't cancel as sums of squares do."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))


def heavy_keys(stats: DataFrame, share: float) -> DataFrame:
    """Keys of ``per_key`` results, neither null nor blank, that hold at least ``share`` of all rows."""
    total = stats.agg(F.sum("n_rows")).first()[0] or 0
    return stats.where((F.col("n_rows") >= share * total) & F.col("key_value").rlike(r"\S"))
