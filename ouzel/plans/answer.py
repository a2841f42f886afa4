"""From a research question to a cited answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.render import citations
from ..operators.retrieval import seed_expand

Writer = Callable[[str, list[tuple[str, str]]], str]
Checker = Callable[[str, str], bool]


def first_sentences(question: str, passages: list[tuple[str, str]]) -> str:
    """A plain writer: the passages themselves with their ids."""
    return " ".join(f"{text.rstrip('.')} [{node}]." for node, text in passages)


def answer(question: str, question_vector: list[float], findings: DataFrame, texts: DataFrame, edges: DataFrame, write: Writer = first_sentences, check: Checker | None = None, k: int = 10, seeds: int = 5) -> dict:
    """The answer's text, its passages, citations and faithfulness (share of supported claims, 0 without any).

    At most ``k`` passages come to the driver.
    """
    spark = findings.sparkSession
    q = spark.createDataFrame([("q", question_vector)], "query_id string, v array<double>")
    top = seed_expand(q, findings, edges, seeds, k).join(texts, "node").orderBy("rank").collect()
    passages = [(r.node, r.text) for r in top]
    text = write(question, passages) if passages else ""
    found = citations(text, {n for n, _ in passages})
    by = dict(passages)
    supported = [by[n].rstrip(".") in context or (check is not None and check(context, by[n])) for n, context in found]
    return {"text": text, "passages": passages, "citations": found, "faithfulness": sum(supported) / len(supported) if supported else 0.0}
