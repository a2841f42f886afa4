"""Agreement and outcome metrics."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def win_rate(ratings: DataFrame) -> DataFrame:
    """``dataset, rater_group, dimension, n, win_rate`` over all combinations, "All" for a margin; no ties."""
    r = ratings.where(F.col("winner") != "tie").withColumn("win", (F.col("winner") == "system").cast("double"))
    x = r.cube("dataset", "rater_group", "dimension").agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"), *(F.grouping(c).alias(f"_{c}") for c in ("dataset", "rater_group", "dimension")))
    return x.select(*(F.when(F.col(f"_{c}") == 1, "All").otherwise(F.col(c)).alias(c) for c in ("dataset", "rater_group", "dimension")), "n", F.round("win_rate", 6).alias("win_rate"))


def fleiss_kappa(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """One row ``n_items, raters, kappa``; kappa is null unless all items have the same two or more raters."""
    per = ratings.groupBy(item, rating).agg(F.count("*").alias("c"))
    items = per.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    a = items.agg(F.count("*").alias("n_items"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p"))
    shares = per.groupBy(rating).agg(F.sum("c").alias("c"))
    e = shares.agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("s")).select((F.col("s") / (F.col("t") * F.col("t"))).alias("pe"))
    good = (F.col("lo") == F.col("hi")) & (F.col("lo") >= 2)
    kappa = F.when(good, F.when(F.col("pe") == 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))))
    pe = e.first().pe  # one number
    return a.withColumn("pe", F.lit(pe)).select("n_items", F.when(good, F.col("lo")).alias("raters"), F.round(kappa, 6).alias("kappa"))


def faithfulness(claims: DataFrame, by: str, supported: str) -> DataFrame:
    return claims.groupBy(by).agg(F.round(F.coalesce(F.avg(F.col(supported).cast("double")), F.lit(0.0)), 6).alias("faithfulness"))


def ablation(insights: DataFrame, arm: str, estimand: str, budget: int = 1000, first: str | None = None) -> DataFrame:
    """Per arm within a budget of rounds: findings, share of different estimands, repeated ones, share of
    deep tests, and the difference of the first share to arm ``first``'s."""
    x = insights.where(F.col("round_id") <= budget)
    a = x.groupBy(arm).agg(
        F.count("*").alias("n"), F.count_distinct(estimand).alias("different"), F.count(estimand).alias("with_estimand"),
        F.avg((F.col("rank") >= 2).cast("double")).alias("deep_share"),
    )
    a = a.withColumn("different_share", F.try_divide(F.col("different"), F.col("n"))).withColumn("repeated", F.col("with_estimand") - F.col("different"))
    base = a.where(F.col(arm) == first).select(F.col("different_share").alias("base"))
    return a.join(F.broadcast(base), how="left").select(arm, "n", "different", "repeated", F.round("deep_share", 6).alias("deep_share"), F.round("different_share", 6).alias("different_share"), F.round(F.col("different_share") - F.col("base"), 6).alias("delta"))


def bounded_log(log: DataFrame, seq: str, cap: int) -> DataFrame:
    """The newest ``cap`` entries."""
    return log.orderBy(F.desc(seq)).limit(cap)


def graduate(log: DataFrame, score: str, tries: str, most: int = 3, least: float = 0.5, most_tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """The best waiting entries with a query, and the log without them (key ``id``)."""
    top = log.where((F.col(score) >= least) & (F.col(tries) < most_tries) & (F.length(F.trim("dsl")) > 0)).orderBy(F.desc(score), "id").limit(most)
    return top, log.join(top.select("id"), "id", "left_anti")
