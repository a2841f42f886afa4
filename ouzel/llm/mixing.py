"""Mixing sources to target shares of tokens by capped water-filling."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..session import stage
from .words import refuse_clash

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Hash buckets per source in the search for the cut of a fractional repetition.
BUCKETS = 4096
_encoders: dict[str, object] = {}


def clean_source(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, runs of other signs as one underscore."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(x != "", x)


def _encoder(path: str):
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
            e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _encoders[path] = lambda t: len(e.encode_ordinary(t))
        elif path.endswith(".model"):
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda t: len(m.encode(t))
        else:
            from tokenizers import Tokenizer

            t_ = Tokenizer.from_file(path)
            t_.encode_special_tokens = True
            _encoders[path] = lambda t: len(t_.encode(t, add_special_tokens=False).ids)
    return _encoders[path]


def token_counts(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The ``keep`` columns and ``tokens``, by the public tokenizer file ``tokenizer``.

    The file must lie at that path on every executor. A null text has 0 tokens.
    """
    refuse_clash(keep, ("tokens", "_text"))
    src = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), "tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        for b in batches:
            count = _encoder(tokenizer)
            b["tokens"] = [count(t) if t else 0 for t in b.pop("_text")]
            yield b

    return src.mapInPandas(run, schema)


def water_fill(shares: dict[str, float], sizes: dict[str, int], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take of each source: its share of ``total``, at most ``caps`` times its size.

    Sources that can't fill their share are clamped and what they lack goes to the others in proportion
    to their shares, until nobody is over the cap or all are clamped.
    """
    take = {s: 0.0 for s in shares}
    free = {s for s, w in shares.items() if w > 0}
    rest = total
    while free:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if rest * shares[s] / weight >= caps[s] * sizes[s]}
        if not full:
            for s in free:
                take[s] = rest * shares[s] / weight
            break
        for s in full:
            take[s] = float(caps[s] * sizes[s])
            rest -= take[s]
        free -= full
    return take


def mix_sources(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Choose documents so that each source gets its share of all tokens.

    ``targets(source, target_share, max_repeat)`` is small (one row per source, collected). Returns
    ``chosen(doc_id, source, tokens, repeats)`` and ``report(source, target_share, max_repeat, n_docs,
    source_tokens, wanted_tokens, chosen_tokens, actual_share, epochs)`` with a row per target.

    ``total_tokens`` defaults to all tokens of the targeted sources. A source's wanted tokens are whole
    repetitions of all its documents and a seeded fraction of one: documents in the order of a hash, as
    long as the sum stays within what is wanted. The cut is found from token sums of hash buckets, so no
    source gathers in one task. Documents with a null or blank source, of sources without a target, and
    without tokens aren't chosen; sources without documents get 0. Targets of one name (after cleaning)
    are added up, with the greatest ``max_repeat``; null shares and repeats count as 0.
    """
    counted = stage(
        token_counts(docs.withColumn("_source", clean_source(F.col(source))).where("_source is not null"), text, [doc_id, "_source"], tokenizer)
        .select(F.col(doc_id).alias("doc_id"), F.col("_source").alias("source"), "tokens")
        .where("tokens > 0")
        .withColumn("u", F.xxhash64(F.lit(seed), "source", F.col("doc_id").cast("string"))),
        "tokens",
    )
    wanted = targets.select(clean_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("max_repeat"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    sizes = counted.join(F.broadcast(wanted.select("source")), "source").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("source_tokens"))
    plan = wanted.join(sizes, "source", "left").fillna(0, ["n_docs", "source_tokens"]).collect()  # a row per target
    total = float(sum(r.source_tokens for r in plan)) if total_tokens is None else float(total_tokens)
    take = water_fill({r.source: r.target_share for r in plan}, {r.source: r.source_tokens for r in plan}, {r.source: r.max_repeat for r in plan}, total)
    spark = docs.sparkSession
    rows = []
    for r in plan:
        whole = int(take[r.source] // r.source_tokens) if r.source_tokens else 0
        rows.append((r.source, r.target_share, r.max_repeat, r.n_docs, r.source_tokens, take[r.source], whole, take[r.source] - whole * r.source_tokens))
    fixed = spark.createDataFrame(rows, "source string, target_share double, max_repeat long, n_docs long, source_tokens long, wanted_tokens double, whole long, part double")
    bucket = F.shiftrightunsigned(F.col("u"), 52).cast("int")
    parted = counted.withColumn("bucket", bucket).join(F.broadcast(fixed.select("source", "whole", "part")), "source")
    sums = parted.groupBy("source", "bucket", "part").agg(F.sum("tokens").alias("m"))
    before = F.sum("m").over(Window.partitionBy("source").orderBy("bucket")) - F.col("m")
    cut = sums.withColumn("before", before).where("before + m > part").groupBy("source").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("cut"))  # the bucket that the fraction ends in
    placed = parted.join(F.broadcast(cut), "source", "left")
    edge = placed.where("bucket = cut.bucket").withColumn("upto", F.col("cut.before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("u", "doc_id")))
    inner = placed.where("cut is null or bucket <> cut.bucket")
    repeats = F.col("whole") + F.when(F.col("extra"), 1).otherwise(0)
    chosen = (
        inner.withColumn("extra", F.when(F.col("cut").isNull(), F.col("part") > 0).otherwise(F.col("bucket") < F.col("cut.bucket"))).select("doc_id", "source", "tokens", repeats.alias("repeats"))
        .unionAll(edge.withColumn("extra", F.col("upto") <= F.col("part")).select("doc_id", "source", "tokens", repeats.alias("repeats")))
        .where("repeats > 0")
    )
    chosen = stage(chosen, "chosen")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"))
    report = fixed.join(got, "source", "left").fillna(0, ["chosen_tokens"])
    whole_sum = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))  # over a row per target
    report = report.select(
        "source", "target_share", "max_repeat", "n_docs", "source_tokens", "wanted_tokens", "chosen_tokens",
        F.coalesce(F.try_divide(F.col("chosen_tokens"), whole_sum), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.try_divide(F.col("chosen_tokens"), F.col("source_tokens")), F.lit(0.0)).alias("epochs"),
    )
    return chosen, report
