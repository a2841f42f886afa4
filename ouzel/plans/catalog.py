"""Variable cards: kinds, candidates, choice of columns for a prompt, glossary."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.render import question_ranges
from ..operators.retrieval import tfidf_topk

HIDDEN_KINDS = ("technical", "contextual", "annex")


def number_of(name: Column) -> Column:
    """The number in a name such as Q12A, or null."""
    return F.regexp_extract(name, r"^[A-Za-z]?[Qq](\d+)", 1).try_cast("int")


def card_text(cards: DataFrame) -> DataFrame:
    """``doc_id, text`` of cards, for retrieval: name, label, question and the texts of options."""
    options = F.concat_ws(" ", F.transform(F.coalesce("options", F.array()), lambda o: o["text"]))
    return cards.select(F.col("var_name").alias("doc_id"), F.concat_ws(" ", F.replace("var_name", F.lit("_"), F.lit(" ")), "module", "label", "question", options).alias("text"))


def kinds(cards: DataFrame) -> DataFrame:
    """``cards`` with ``n_options`` and ``kind``: by the options' codes, and technical by name or module."""
    codes = F.array_compact(F.transform(F.coalesce("options", F.array()), lambda o: o["code"].try_cast("int")))
    run = F.array_max("_c") - F.array_min("_c") + 1 == F.size("_c")
    words = F.lower(F.concat_ws(" ", "module", "label"))
    kind = (
        F.when(words.rlike(r"weight|interview(er)? (id|number)|version|serial"), "technical").when(words.rlike(r"country|region|settlement"), "contextual")
        .when(F.size("_c") == 2, "binary").when((F.size("_c") > 2) & run, "ordinal").when(F.size("_c") > 2, "nominal").otherwise("index")
    )
    return cards.withColumn("_c", codes).withColumns({"n_options": F.size("_c"), "kind": kind}).drop("_c")


def candidates(cards: DataFrame, module: str | None = None, ranges: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Cards that may be offered: no technical or contextual ones, indexes only if named like questions.

    A module matches in either direction; a range of numbers excludes only numbered names outside of it.
    """
    x = kinds(cards).where(~F.col("kind").isin(*HIDDEN_KINDS) & ((F.col("kind") != "index") | F.upper("var_name").startswith("Q")))
    if module:
        m = F.lower(F.coalesce("module", F.lit("")))
        x = x.where((m != "") & (F.contains(m, F.lit(module.lower())) | F.contains(F.lit(module.lower()), m)))
    if ranges:
        n = number_of(F.col("var_name"))
        inside = F.lit(False)
        for lo, hi in question_ranges(ranges):
            inside = inside | n.between(lo, hi)
        x = x.where(n.isNull() | inside)
    return x if only is None else x.where(F.col("var_name").isin(*only))


def choose_columns(cards: DataFrame, needs: DataFrame, k: int = 40, always: list[str] | None = None, per_module: int = 3, covariates: list[str] | None = None, reserve: int = 5, stop: list[str] | None = None) -> DataFrame:
    """``var_name, reason, rank``: at most ``k`` columns for what is asked.

    First those always kept, then the best ``per_module`` of each module by tf-idf against ``needs(query_id,
    text)``, then up to ``reserve`` covariates, then the best of the rest. Ties go by name.
    """
    pool = candidates(cards)
    score = tfidf_topk(card_text(pool), needs, 10_000, stop).groupBy(F.col("doc_id").alias("var_name")).agg(F.max("score").alias("score"))
    x = cards.select("var_name", "module").join(score, "var_name", "left").join(pool.select("var_name", F.lit(True).alias("offered")), "var_name", "left")
    x = x.withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy("offered", "module").orderBy(F.desc("score"), "var_name"))
    is_in = lambda names: F.col("var_name").isin(*names) if names else F.lit(False)
    x = x.withColumn("n", best).withColumn("tier", F.when(is_in(always), 0).when(F.col("offered") & (F.col("n") <= per_module) & (F.col("score") > 0), 1).when(is_in((covariates or [])[:reserve]), 2).when(F.col("offered") & (F.col("score") > 0), 3))
    top = x.where("tier is not null").orderBy("tier", F.desc("score"), "var_name").limit(k)
    reason = F.array(*map(F.lit, ("always", "module", "covariate", "score")))
    return top.select("var_name", reason[F.col("tier")].alias("reason"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", F.desc("score"), "var_name")).alias("rank"))


def glossary(cards: DataFrame, most_options: int = 6) -> DataFrame:
    """``var_name, line``: a line for a prompt from each card."""
    shown = F.slice(F.coalesce("options", F.array()), 1, most_options)
    options = F.concat_ws("; ", F.transform(shown, lambda o: F.concat_ws("=", o["code"], o["text"])))
    more = F.when(F.size("options") > most_options, "; ...").otherwise("")
    return cards.select("var_name", F.concat(F.col("var_name"), F.lit(": "), F.coalesce("label", F.lit("")), F.when(F.length(options) > 0, F.concat(F.lit(" ("), options, more, F.lit(")"))).otherwise("")).alias("line"))
