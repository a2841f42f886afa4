"""Connected components of an undirected graph by distributed label propagation."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..session import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of ``edges``; ``component`` is the least node in it.

    Each round, a node takes the least label among its own and its neighbours', then the label's own
    label (pointer jumping), so the number of rounds grows with the logarithm of a component's extent.
    Messages are reduced to one minimum per node before the shuffle, so hubs make no large tasks.
    Null ends are ignored, self-loops keep a node alone, repeated edges change nothing.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = stage(e.unionAll(e.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("root"))
        new = stage(step.join(jump, step.new == jump.via, "left").select("node", "old", F.least("new", "root").alias("label")), "labels")
        if new.where("label < old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
