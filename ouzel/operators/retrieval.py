"""Similarity and retrieval."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window

from ..session import stage


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def scaled(cos: Column) -> Column:
    """To 0..1."""
    return (cos + 1) / 2


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, least: float | None = None, most_queries: int = 100_000, digits: int | None = None) -> DataFrame:
    """``query_id, item_id, similarity, rank``: the exact k nearest items of each query by (cosine + 1) / 2.

    ``queries(query_id, v)`` are sent out, in blocks by hash of about ``most_queries`` with a pass each if there are more,
    norms are computed once, and each task keeps k items of a query before anything is shuffled. Equal similarities go by
    item id, after rounding to ``digits`` if given; an item isn't its own neighbour.
    """
    blocks = -(-queries.count() // most_queries)
    if blocks > 1:
        queries, items = stage(queries.select("query_id", "v"), "queries"), stage(items.select("item_id", "v"), "items")
        parts = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks))
        return reduce(DataFrame.unionAll, [stage(_nearest(q, items, k, least, digits), "nearest") for q in parts])
    return _nearest(queries, items, k, least, digits)


def _nearest(queries: DataFrame, items: DataFrame, k: int, least: float | None, digits: int | None) -> DataFrame:
    q = queries.select("query_id", F.col("v").alias("qv"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("qn"))
    i = items.select("item_id", F.col("v").alias("iv"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("vn"))
    s = i.join(F.broadcast(q), F.col("query_id").cast("string") != F.col("item_id").cast("string"))
    s = s.select("query_id", "item_id", scaled(F.coalesce(F.try_divide(dot(F.col("qv"), F.col("iv")), F.col("qn") * F.col("vn")), F.lit(0.0))).alias("similarity"))
    if digits is not None:
        s = s.withColumn("similarity", F.round("similarity", digits))
    if least is not None:
        s = s.where(F.col("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_pairs(items: DataFrame, least: float, block: int = 1000) -> DataFrame:
    """``item_a, item_b, similarity``: all pairs of ``items(item_id long, v)``, ``item_a`` < ``item_b``, at a (cosine + 1) / 2 of ``least`` or more.

    Vectors are cut by hash into blocks of about ``block``; each pair of blocks is one product of matrices, so that
    no task holds more however many there are. Null vectors have no pairs; work grows with the square of their number.
    """
    x = items.where("item_id is not null and v is not null").select("item_id", "v")
    n = max(1, -(-x.count() // block))
    x = x.withColumn("b", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = x.withColumn("o", other).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("left"), (F.col("b") >= F.col("o")).alias("right"), "item_id", "v")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in ("left", "right"):
            part = cell[cell[side]]
            m = np.stack(part["v"].to_numpy()).astype(float) if len(part) else np.zeros((0, 0))
            norm = np.sqrt((m * m).sum(1, keepdims=True)) if len(part) else m
            sides.append((part["item_id"].to_numpy(np.int64), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))
        (ids, a), (jds, b) = sides
        if not len(ids) or not len(jds):
            return pd.DataFrame({"item_a": ids[:0], "item_b": jds[:0], "similarity": np.zeros(0)})
        s = (a @ b.T + 1) / 2
        r, c = np.nonzero(s >= least)
        x, y = ids[r], jds[c]
        # within one block each pair comes up twice, and each vector meets itself
        use = x < y if cell["i"].iloc[0] == cell["j"].iloc[0] else x != y
        return pd.DataFrame({"item_a": np.minimum(x, y)[use], "item_b": np.maximum(x, y)[use], "similarity": s[r, c][use]})

    return cells.groupBy("i", "j").applyInPandas(compare, "item_a long, item_b long, similarity double")


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Words of two letters or more without stop words, and pairs of neighbours."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    bad = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~F.array_contains(bad, x))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def tfidf(docs: DataFrame, stop: list[str] | None = None, features: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, term, w)`` with unit length per document, and ``(term, idf)`` of the most frequent terms.

    idf = ln((1 + n) / (1 + df)) + 1; terms go by document frequency, then by name.
    """
    t = stage(docs.select("doc_id", F.explode(terms(F.col("text"), stop)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "terms")
    n = docs.agg(F.count("*").alias("n"))
    df = t.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(features)
    idf = df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return weigh(t, idf), idf


def weigh(tf: DataFrame, idf: DataFrame) -> DataFrame:
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_topk(cards: DataFrame, queries: DataFrame, k: int, stop: list[str] | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: cosine of tf-idf weights; the model is that of the cards."""
    weights, idf = tfidf(cards, stop)
    q = stage(queries.select(F.col("query_id").alias("doc_id"), F.explode(terms(F.col("text"), stop)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "terms")
    qw = weigh(q, idf).select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))
    s = weights.join(qw, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def seed_expand(queries: DataFrame, findings: DataFrame, edges: DataFrame, seeds: int = 5, k: int = 10) -> DataFrame:
    """``query_id, node, score, rank``: the nearest findings and their neighbours by 0.6 similarity + 0.4 validity.

    ``queries(query_id, v)``, ``findings(node, v, validity)``. Only the ``seeds`` nearest findings of a query leave the search,
    so that pairs are those of a query with its seeds and their neighbours. Similarities count to six digits.
    """
    first = cosine_topk(queries, findings.select(F.col("node").alias("item_id"), "v"), seeds, digits=6).select("query_id", F.col("item_id").alias("node"))
    first = stage(first, "seeds")
    e = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    both = e.unionAll(e.select("b", "a"))
    near = first.join(both, first.node == both.a).select("query_id", F.col("b").alias("node"))
    pool = first.unionAll(near).distinct().join(findings, "node").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    similarity = F.round(scaled(cosine(F.col("qv"), F.col("v"))), 6)
    pool = pool.withColumn("score", F.round(0.6 * similarity + 0.4 * F.coalesce("validity", F.lit(0.0)), 6))
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))).where(F.col("rank") <= k).select("query_id", "node", "score", "rank")


def diverse_greedy(items: DataFrame, k: int, most_similar: float) -> list[tuple[str, float]]:
    """Greedy choice over a whole table ``(node, score, v)``: the best score (of equals the greatest node), then the
    best whose cosine with all chosen ones is at most ``most_similar``, and so on up to ``k``.

    Each choice is one distributed top-1 over what is left, so only the chosen rows come to the driver.
    """
    left, chosen = items.where(F.col("score").isNotNull() & ~F.isnan("score")), []
    while len(chosen) < k:
        best = left.orderBy(F.desc("score"), F.desc("node")).first()
        if best is None:
            break
        chosen.append((best.node, best.score))
        v = F.array(*(F.lit(float(x)) for x in best.v))
        left = left.where((F.col("node") != best.node) & (cosine(F.col("v"), v) <= most_similar))
    return chosen


def diverse_topk(rows: list[tuple[str, float, np.ndarray]], k: int, most_similar: float) -> list[str]:
    """Greedy choice by falling score (of equals the last one first), skipping what is too like a chosen one.

    Each choice depends on those before, so it runs on the driver over a bounded list of candidates.
    """
    chosen: list[int] = []
    unit = [v / (np.linalg.norm(v) or 1.0) for _, _, v in rows]
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][1], -i)):
        if all(float(unit[i] @ unit[j]) <= most_similar for j in chosen):
            chosen.append(i)
            if len(chosen) == k:
                break
    return [rows[i][0] for i in chosen]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the least total cost, by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        best, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while row >= 0:
            if col >= 0:
                done[col] = True
            slack = c[row] - u[row] - v
            slack += best[col] if col >= 0 else 0.0
            better = ~done & (slack < best)
            best[better], prev[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, best)))
            row = row_of[col]
        total = best[col]
        u[i] += total
        for j in np.nonzero(done)[0]:
            u[row_of[j]] += total - best[j]
            v[j] -= total - best[j]
        while col >= 0:
            before = prev[col]
            row_of[col] = row_of[before] if before >= 0 else i
            col = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def hashed_vectors(docs: DataFrame, dims: int = 256, stop: list[str] | None = None) -> DataFrame:
    """``doc_id, v``: signed term counts in ``dims`` hash buckets, of unit length, where no model gives vectors.

    Documents without terms have a zero vector.
    """
    h = F.xxhash64("term")
    t = docs.select("doc_id", F.explode_outer(terms(F.coalesce("text", F.lit("")), stop)).alias("term"))
    b = t.select("doc_id", F.pmod(h, F.lit(dims)).cast("int").alias("b"), F.when(F.col("term").isNull(), 0.0).when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("w")).groupBy("doc_id", "b").agg(F.sum("w").alias("w"))
    m = b.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # dims entries at most
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("norm")), F.lit(0.0)))
    return m.select("doc_id", v.alias("v"))


def grounding(phrases: DataFrame, cards: DataFrame, top: int = 3, least: float = 0.05, share: float = 0.55) -> DataFrame:
    """``query_id, share, grounded``: the share of a query's phrases with a card among the first ``top`` that
    scores at least ``least``. ``phrases(query_id, phrase_id, text)``."""
    hits = tfidf_topk(cards, phrases.select(F.concat_ws("#", "query_id", "phrase_id").alias("query_id"), "text"), top).where(F.col("score") >= least).select(F.col("query_id").alias("h")).distinct()
    x = phrases.withColumn("h", F.concat_ws("#", "query_id", "phrase_id")).join(hits.withColumn("ok", F.lit(1.0)), "h", "left")
    return x.groupBy("query_id").agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("share")).withColumn("grounded", F.col("share") >= share)
