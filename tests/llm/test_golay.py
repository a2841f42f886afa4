import itertools
import random
import time

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from ouzel.llm import golay as G
from ouzel.llm.words import WORD

WORDS = [f"w{i}" for i in range(400)]


def test_code_is_perfect():
    g = G.golay()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    own = g.decode(x)
    assert own.min() >= 0 and own.max() < 4096
    # decoding undoes any three errors of a codeword
    codewords = x ^ g.error[g.low[x & 4095] ^ g.high[x >> 12]]
    for k in range(4):
        places = [rng.choice(23, k, replace=False) for _ in codewords]
        noisy = codewords ^ np.array([sum(1 << int(p) for p in ps) for ps in places])
        assert (g.decode(noisy) == g.decode(codewords)).all()


def test_two_errors_share_an_index():
    g = G.golay()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 300)
    for k in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for p in rng.choice(23, k, replace=False):
                y[i] ^= 1 << int(p)
        (rx, kx), (ry, ky) = g.indices(x), g.indices(y)
        for i in range(len(x)):
            assert set(kx[rx == i]) & set(ky[ry == i])
    rows, keys = g.indices(x)
    assert set(np.bincount(rows)) <= {1, 6}


def _jaccard(a, b, n):
    s = [set(zip(*(WORD.findall(t.lower())[i:] for i in range(n)))) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def _docs():
    rng = random.Random(4)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 90))) for _ in range(120)]
    docs = list(base)
    for t in base[:60]:
        w = t.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        docs.append(" ".join(w).upper() + "!")
    docs += base[:7] + base[:3]  # exact copies
    docs += ["short text", "", None, "   ", " ".join(WORDS * 30)]
    return docs


@pytest.mark.parametrize("shingle,threshold", [(3, 0.6), (5, 0.8)])
def test_against_brute_force(spark, shingle, threshold):
    docs = _docs()
    df = spark.createDataFrame([("f", f"{i:04d}", t) for i, t in enumerate(docs)], "field string, id string, text string")
    got = {(r.id_a, r.id_b) for r in G.near_copy_rows(df, threshold=threshold, shingle=shingle).collect()}
    want = set()
    usable = [(i, t) for i, t in enumerate(docs) if t and len(WORD.findall(t)) >= 20]
    for (i, a), (j, b) in itertools.combinations(usable, 2):
        if _jaccard(a, b, shingle) >= threshold:
            want.add((f"{i:04d}", f"{j:04d}"))
    assert got - want == set()
    assert len(got & want) >= 0.97 * len(want)


def test_fields_stay_apart_and_groups(spark):
    t = " ".join(WORDS[:40])
    rows = [("f", "1", t), ("g", "2", t), ("f", "3", t), ("f", "4", t.replace("w5 ", "x5 ")), ("f", "5", " ".join(WORDS[100:140]))]
    df = spark.createDataFrame(rows, "field string, id string, text string").withColumn("group", F.lit(1)).withColumn("u", F.lit("clash"))
    assert {(r.field, r.id_a, r.id_b) for r in G.near_copy_rows(df, threshold=0.6, shingle=3).collect()} == {("f", "1", "3"), ("f", "1", "4"), ("f", "3", "4")}
    got = {(r.field, r.id): (r.group, r.links) for r in G.near_copy_groups(df, threshold=0.6, shingle=3).collect()}
    assert got == {("f", "1"): ("1", 2), ("f", "3"): ("1", 2), ("f", "4"): ("1", 1), ("f", "5"): ("5", 0), ("g", "2"): ("2", 0)}


def test_repeated_rows_and_empty(spark):
    t = " ".join(WORDS[:30])
    df = spark.createDataFrame([("f", "1", t), ("f", "1", t), ("f", "2", t + " more")], "field string, id string, text string")
    assert {(r.id_a, r.id_b) for r in G.near_copy_rows(df, threshold=0.6, shingle=3).collect()} == {("1", "2")}
    none = spark.createDataFrame([], "field string, id string, text string")
    assert G.near_copy_rows(none, threshold=0.6, shingle=3).count() == 0
    assert G.near_copy_groups(none).count() == 0


def _reposts(rng, n):
    """Texts, and the same with a block of other words after them or with their halves swapped."""
    out = []
    for i in range(n):
        own, other = ([f"{side}{i}x{k}" for k in range(rng.randint(40, 90))] for side in "pq")
        more = other[: int(len(own) * rng.uniform(0.2, 0.6))]
        out += [" ".join(own), " ".join(own + more) if i % 2 else " ".join(own[len(own) // 2 :] + own[: len(own) // 2] + more[: len(more) // 2])]
    return out


def test_all_that_share_a_key_are_compared_exactly(spark):
    docs = _reposts(random.Random(8), 1000)
    df = spark.createDataFrame([("f", f"{i:04d}", t) for i, t in enumerate(docs)], "field string, id string, text string")
    got = {(r.id_a, r.id_b) for r in G.near_copy_rows(df, threshold=0.6, shingle=3).collect()}
    _, anchors, near, whole, *_ = G.fingerprints(docs, G.segments_for(0.6), 3, 20)
    of = [set() for _ in docs]
    for s in range(near.shape[1]):
        for r, index in zip(*G._indices_of(near[:, s].astype(np.int64) | whole[:, s % G.WHOLE].astype(np.int64) << G.BITS)):
            of[r].add((s, *anchors[r, 2 * s : 2 * s + 2].tolist(), int(index)))
    true = [i for i in range(0, len(docs), 2) if _jaccard(docs[i], docs[i + 1], 3) >= 0.6]
    sharing = {(f"{i:04d}", f"{i + 1:04d}") for i in true if of[i] & of[i + 1]}
    assert len(sharing) > 500 and sharing - got == set()
    assert got <= {(f"{i:04d}", f"{i + 1:04d}") for i in true}


def test_added_and_moved_blocks_are_found(spark):
    docs = _reposts(random.Random(21), 3000)
    df = spark.createDataFrame([("f", f"{i:04d}", t) for i, t in enumerate(docs)], "field string, id string, text string")
    got = {(r.id_a, r.id_b) for r in G.near_copy_rows(df, threshold=0.6, shingle=3).collect()}
    true = {(f"{i:04d}", f"{i + 1:04d}") for i in range(0, len(docs), 2) if _jaccard(docs[i], docs[i + 1], 3) >= 0.6}
    assert len(true) > 1500 and got <= true
    assert len(true - got) <= G.MISS * len(true)


def test_segments_bound_the_chance_of_a_miss():
    for t in (0.05, 0.2, 0.3, 0.45, 0.6, 0.8, 0.99, 1.0):
        assert (1 - G.SHARE * t**2 * (1 - (1 - t) ** G.MORE) ** G.DEPTH) ** G.segments_for(t) <= G.MISS * 1.001


ZIPF = [f"z{i}" for i in range(20000)]
_WEIGHTS = list(itertools.accumulate(1 / (i + 3) for i in range(20000)))


def _text(rng, n):
    return rng.choices(ZIPF, cum_weights=_WEIGHTS, k=n)


def _changed(rng, w, n):
    """Words changed, added and left out."""
    out = []
    for x in w:
        if rng.random() < n / 2:
            out.append(rng.choice(ZIPF))
        if rng.random() >= n / 2:
            out.append(rng.choice(ZIPF) if rng.random() < n / 2 else x)
    return out


def _put_in(rng, w, share):
    k = rng.randrange(len(w))
    return w[:k] + _text(rng, int(len(w) * share)) + w[k:]


def _reordered(rng, w):
    n = rng.randint(9, 25)
    parts = [w[i : i + n] for i in range(0, len(w), n)]
    rng.shuffle(parts)
    return [x for p in parts for x in p]


EDITS = {
    "words": lambda rng, w: _changed(rng, w, rng.uniform(0.01, 0.1)),
    "block after": lambda rng, w: w + _text(rng, int(len(w) * rng.uniform(0.05, 0.6))),
    "block within": lambda rng, w: _put_in(rng, w, rng.uniform(0.05, 0.6)),
    "end cut off": lambda rng, w: w[: int(len(w) * rng.uniform(0.6, 0.95))],
    "parts reordered": _reordered,
}


@pytest.mark.parametrize("shingle,threshold", [(3, 0.6), (5, 0.8)])
def test_recall_by_kind_of_edit_and_similarity(spark, shingle, threshold):
    rng = random.Random(17)
    docs, kind = [], []
    for name, edit in EDITS.items():
        for _ in range(500):
            own = _text(rng, rng.choice([25, 40, 70, 150]))
            docs += [" ".join(own), " ".join(edit(rng, own))]
            kind.append(name)
    df = spark.createDataFrame([("f", f"{i:05d}", t) for i, t in enumerate(docs)], "field string, id string, text string")
    got = {(r.id_a, r.id_b) for r in G.near_copy_rows(df, threshold=threshold, shingle=shingle).collect()}
    true, lost = {}, {}
    for i in range(0, len(docs), 2):
        if min(len(docs[i].split()), len(docs[i + 1].split())) >= 20 and (j := _jaccard(docs[i], docs[i + 1], shingle)) >= threshold:
            for band in (kind[i // 2], min(int(j * 10), 9)):
                true[band] = true.get(band, 0) + 1
                lost[band] = lost.get(band, 0) + ((f"{i:05d}", f"{i + 1:05d}") not in got)
    assert set(EDITS) < set(true) and len(true) >= len(EDITS) + 2
    for band, n in true.items():
        assert n > 20 and lost[band] <= max(1, 0.01 * n), (band, n, lost[band])


def test_spread_rows_give_the_same_candidates():
    rng = np.random.default_rng(5)
    u = np.arange(600, dtype=np.int64)
    vectors = rng.integers(0, 1 << 23, 6)
    flips = lambda: np.array([sum({1 << int(p) for p in rng.integers(0, 23, 3)}) for _ in u])
    near, whole = (vectors[rng.integers(0, 6, len(u))] ^ flips() for _ in "ab")
    rows = pd.DataFrame({"key": np.sort(rng.integers(0, 2, len(u))), "u": u, "vectors": whole << G.BITS | near})
    pairs = lambda b: {(x, y) for p in G._pairs_of(b.sort_values("key", ignore_index=True), 0) for x, y in zip(p["u_a"], p["u_b"])}
    want = pairs(rows)
    assert len(want) > 1000
    for common in (10, 3 * G.BLOCK // G.SAMPLED):
        (spread,) = G._spread(iter([rows.assign(common=common)]))
        assert pairs(spread) == want
    # batches that cut a key apart give what whole ones do
    many = pd.concat([rows.assign(key=rows["key"] + 2 * k, u=rows["u"] + 600 * k) for k in range(4)], ignore_index=True)
    cut = [many.iloc[i : i + 97] for i in range(0, len(many), 97)]
    assert len(pd.concat(G._candidate_stage(0.6)(iter(cut))).drop_duplicates()) == 4 * len(want)


def test_common_anchors_need_more_of_them():
    rng = np.random.default_rng(9)
    key = np.sort(np.concatenate([np.zeros(400, np.int64), np.ones(200, np.int64), np.arange(2, 300) // 20 + 2]))
    more = sum(rng.integers(0, 4, len(key)) << G.BIT * k for k in range(G.MORE * G.DEPTH))
    more |= np.where(key == 1, 1, 0) << G.BIT * G.MORE * G.DEPTH  # sent by the third anchor already
    b = pd.DataFrame({"key": key, "u": rng.permutation(len(key)).astype(np.int64), "vectors": np.full(len(key), 12345), "more": more})
    got = {(x, y) for p in G._pairs_of(b, 0) for x, y in zip(p["u_a"], p["u_b"])}
    part = lambda m, step, k: int(m) >> G.BIT * (G.MORE * (G.DEPTH - 1 - step) + k) & (1 << G.BIT) - 1

    def pairs(rows, step):
        if len(rows) < G.COMMON or step == G.DEPTH:
            return {(min(x, y), max(x, y)) for x, y in itertools.combinations((r.u for r in rows), 2)}
        if rows[0].more >> G.BIT * G.MORE * G.DEPTH > step:
            return pairs(rows, step + 1)
        return set().union(*(pairs([r for r in rows if part(r.more, step, k) == v], step + 1) for k in range(G.MORE) for v in range(4)))

    rows = list(b.itertuples())
    want = set().union(*(pairs([r for r in rows if r.key == k], 0) for k in set(key)))
    assert got == want and 10_000 < len(want) < 400 * 399 / 2


def test_candidates_send_a_row_a_segment_and_free_their_disk(spark):
    from pathlib import Path

    rng = random.Random(3)
    docs = [" ".join(rng.choices(WORDS[:6], k=40)) for _ in range(400)]  # texts share many phrases
    df = spark.createDataFrame([("f", f"{i:04d}", t) for i, t in enumerate(docs)], "field string, id string, text string")
    dirs = [Path(str(x)) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before = shuffled()
    seen, stage = [], G.stage

    def staged(frame, label="stage", **options):
        if label == "part":
            text = frame._jdf.queryExecution().optimizedPlan().toString()
            seen.append(text.count("Generate explode"))
        return stage(frame, label, **options)

    G.stage = staged
    try:
        members, pairs, _ = G.near_copies(df, threshold=0.6, shingle=3)
    finally:
        G.stage = stage
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    assert seen == [1] * G.PASSES  # no row is sent once more for a further anchor
    assert members.count() == 400
