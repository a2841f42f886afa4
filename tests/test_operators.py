import itertools

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from ouzel.functions import text as X
from ouzel.operators import cleaning, graph, levels, metrics, retrieval
from ouzel.operators.components import connected_components
from ouzel.operators.gram import correlations, gram
from ouzel.operators.prescan import critical_r, module_rollup, prescan, significant
from ouzel.operators.ranks import mid_ranks
from ouzel.operators.skew import heavy_keys, per_key
from ouzel.queries.pipeline import MODULES
from ouzel.queries.statistics import NUMBERS, QUERIES


def test_gram(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 3))
    df = spark.createDataFrame(pd.DataFrame(a, columns=list("abc"))).repartition(3)
    assert np.allclose(gram(df, [F.col(c) for c in "abc"]), a.T @ a)


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame(rng.normal(size=(300, 3)) + 1e6, columns=list("abc"))
    p.loc[::3, "a"] = np.nan
    p.loc[::7, "b"] = np.inf
    got = {(r.a, r.b): (r.n, r.r) for r in correlations(spark.createDataFrame(p), list("abc")).collect()}
    for a, b in itertools.combinations("abc", 2):
        q = p[[a, b]].replace(np.inf, np.nan).dropna()
        assert got[a, b][0] == len(q) and got[a, b][1] == pytest.approx(q.corr().iloc[0, 1], abs=1e-9)


def test_prescan_significance(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"a": rng.normal(size=400)})
    p["b"] = p.a + rng.normal(size=400)
    p["c"] = rng.normal(size=400)
    rows = prescan(spark.createDataFrame(p), list("abc"), {"a": "m", "b": "k"}).collect()
    assert rows[0].a == "a" and rows[0].b == "b" and rows[0].cross
    for r in rows:
        assert abs(r.r) >= critical_r(r.n, 0.01) - 1e-4


def test_significance_of_large_and_least_n(spark):
    cases = [(n, critical_r(n, 0.01) * by) for n in (100, 300_000, 5_000_000, 10**10) for by in (0.999, 1.001)] + [(2, 1.0)]
    got = spark.createDataFrame(cases, "n long, r double").select(F.coalesce(significant(F.col("r"), F.col("n"), 0.01), F.lit(False)).alias("yes"))
    assert [r.yes for r in got.collect()] == [False, True] * 4 + [False]


def test_prescan_cap_of_many_rows(spark, tmp_path):
    many = spark.range(300_000).select(*(((F.col("id") % 7) * i + F.col("id") % (11 + i)).alias(c) for i, c in enumerate(NUMBERS)))
    many.write.parquet(f"{tmp_path}/amazon_books_autokd.parquet")
    got = QUERIES["prescan_cap"](spark, str(tmp_path)).collect()
    p = many.toPandas().corr()
    want = {(a, b): p.loc[a, b] for a, b in itertools.combinations(NUMBERS, 2) if abs(p.loc[a, b]) >= 0.03}
    assert 0 < len(want) == len(got) and all(r.n == 300_000 and r.r == pytest.approx(want[r.a, r.b], abs=1e-6) for r in got)
    order = [(not r.cross, -abs(r.r)) for r in got]
    assert order == sorted(order) and all(r.cross == (MODULES[r.a] != MODULES[r.b]) for r in got)


def test_module_rollup_of_many_rows(spark):
    many = spark.range(300_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 5 + F.col("id") % 7).alias("b"))
    x = module_rollup(prescan(many, ["a", "b"], {"a": "m", "b": "k"}, p=1.0, least_r=0.0, cap=None)).collect()
    assert [(r.module_1, r.module_2, r.n, r.top_pairs) for r in x] == [("k", "m", 1, ["a~b"])]
    assert x[0].mean_abs_r == pytest.approx(many.agg(F.corr("a", "b")).first()[0], abs=1e-6)


def test_module_pair_rollup_names_strongest_pairs(spark, tmp_path):
    rng = np.random.default_rng(4)
    p = pd.DataFrame(rng.normal(size=(2000, len(NUMBERS))) + rng.normal(size=(2000, 1)) * np.linspace(0.1, 1, len(NUMBERS)), columns=NUMBERS)
    p["review_avg_word_length"] = -2 * p.review_word_count  # ties
    spark.createDataFrame(p).repartition(5).write.parquet(f"{tmp_path}/amazon_books_autokd.parquet")
    got = QUERIES["module_pair_rollup"](spark, str(tmp_path)).collect()
    want, r = {}, p.corr().abs().round(9)
    for a, b in itertools.combinations(NUMBERS, 2):
        want.setdefault(tuple(sorted((MODULES[a], MODULES[b]))), []).append((-r.loc[a, b], a, b))
    assert {(x.module_1, x.module_2): (x.n, x.top_pairs) for x in got} == {k: (len(v), ",".join(f"{a}~{b}" for _, a, b in sorted(v)[:5])) for k, v in want.items()}


def test_module_rollup_ties_by_name(spark):
    pairs = spark.createDataFrame([("b", "c", 0.1 + 0.2, "m", "k"), ("a", "d", -0.3, "k", "m"), ("a", "c", 0.2999, "k", "m")], "a string, b string, r double, module_a string, module_b string")
    assert module_rollup(pairs, top=2).first().top_pairs == ["a~d", "b~c"]


def test_mid_ranks(spark):
    v = np.random.default_rng(0).integers(0, 50, 500)
    got = {r.value: r.mid_rank for r in mid_ranks(spark.createDataFrame([(int(x),) for x in v], "v int"), "v").collect()}
    s = pd.Series(v).rank()
    assert got == {int(x): float(s[i]) for i, x in enumerate(v)}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 3)], "src int, dst int")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def _expected(p):
    out = {}
    for k, g in p.groupby("k", dropna=False):
        o = g.o.dropna().sort_values().to_numpy()
        v = g.v.dropna()
        out[None if pd.isna(k) else k] = (len(g), len(v), v.mean() if len(v) else None, v.std() if len(v) > 1 else None, int(np.diff(o).max()) if len(o) > 1 else None)
    return out


def test_per_key_with_heavy_keys(spark):
    rng = np.random.default_rng(7)
    n = 6000
    keys = np.where(rng.random(n) < 0.4, "hot", np.where(rng.random(n) < 0.1, None, np.char.add("k", rng.integers(0, 200, n).astype(str))))
    p = pd.DataFrame({"k": keys, "o": rng.integers(0, 10**6, n).astype(float), "v": rng.normal(size=n), "id": np.arange(n), "n": 1})
    p.loc[rng.random(n) < 0.05, "o"] = np.nan
    p.loc[rng.random(n) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(list(zip(p.k, [None if pd.isna(x) else int(x) for x in p.o], p.id, [None if pd.isna(x) else float(x) for x in p.v], p.n)), "k string, o long, id long, v double, n int")
    got = per_key(df, "k", "o", "id", "v", partitions=9).collect()
    want = _expected(p)
    assert len(got) == len(want)
    for r in got:
        w = want[r.key_value]
        assert (r.n_rows, r.n_values, r.longest_gap) == (w[0], w[1], w[4]), r
        for a, b in ((r.mean_value, w[2]), (r.std_value, w[3])):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


def test_per_key_small_cases(spark):
    schema = "k string, o long, id long, v double"
    assert per_key(spark.createDataFrame([], schema), "k", "o", "id", "v").count() == 0
    df = spark.createDataFrame([(None, None, 1, None), ("", 3, 2, float("nan")), ("a", 1, 3, 2.0), ("a", 1, 3, 2.0)], schema)
    got = {r.key_value: r for r in per_key(df, "k", "o", "id", "v").collect()}
    assert got[None].n_rows == 1 and got[None].mean_value is None and got[""].n_values == 0
    assert got["a"].n_rows == 2 and got["a"].longest_gap == 0 and got["a"].std_value == 0
    assert [r.key_value for r in heavy_keys(per_key(df, "k", "o", "id", "v"), 0.2).collect()] == ["a"]


def test_collapse_rare(spark):
    rows = [("a",)] * 50 + [("b",)] * 40 + [(f"r{i}",) for i in range(35)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "g string")
    for x in (levels.collapse_rare(df, "g")[0], levels.collapse_rare_join(df, "g")):
        assert {r.g: r["count"] for r in x.groupBy("g").count().collect()} == {"a": 50, "b": 40, "Other": 35, None: 3}
    few = spark.createDataFrame(rows[:90] + [("z",)], "g string")
    assert levels.collapse_rare(few, "g")[0].where("g is null").count() == 1 == levels.collapse_rare_join(few, "g").where("g is null").count()
    none = spark.createDataFrame([("z",)] * 5, "g string")
    assert levels.collapse_rare_join(none, "g").where("g = 'z'").count() == 5


def test_stratified_take_is_exact_and_stable(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as s")
    a, b = (levels.stratified_take(df.repartition(n), "s", "id", 0.1, seed=1) for n in (2, 5))
    assert {r.s: r["count"] for r in a.groupBy("s").count().collect()} == {0: 167, 1: 167, 2: 167}
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}


def test_graph_small(spark):
    e = spark.createDataFrame([("b", "a", "deepens"), ("c", "b", "deepens"), ("c", "d", "narrows"), ("e", "c", "contradicts")], "source_id string, target_id string, relation_type string")
    start = spark.createDataFrame([("c",)], "node string")
    assert {(r.node, r.hop) for r in graph.k_hop(e, start, 2).collect()} == {("b", 1), ("d", 1), ("e", 1), ("a", 2)}
    assert {(r.node, r.hop) for r in graph.k_hop(e, start, 5, "out", ["deepens"]).collect()} == {("b", 1), ("a", 2)}
    assert [(r.depth, r.node) for r in graph.ancestors(e, start).orderBy("depth").collect()] == [(1, "b"), (2, "a")]
    new = spark.createDataFrame([("b", "a", "extends")], "source_id string, target_id string, relation_type string")
    assert {r.relation_type for r in graph.upsert_edges(e, new).where("source_id = 'b'").collect()} == {"extends"}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for shape in ((4, 4), (3, 6), (6, 3)):
        c = rng.random(shape)
        got = sum(c[i, j] for i, j in retrieval.assign(c))
        t = c if shape[0] <= shape[1] else c.T
        best = min(sum(t[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))
        assert got == pytest.approx(best)


def test_diverse_topk():
    v = [np.array([1.0, 0]), np.array([1.0, 0.01]), np.array([0.0, 1])]
    assert retrieval.diverse_topk([("a", 1.0, v[0]), ("b", 1.0, v[1]), ("c", 0.5, v[2])], 2, 0.9) == ["b", "c"]


def test_diverse_greedy_agrees(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{i:02d}", float(rng.integers(0, 5)), rng.normal(size=4)) for i in range(40)]
    df = spark.createDataFrame([(n, s, v.tolist()) for n, s, v in rows] + [("z", None, [1.0, 0.0, 0.0, 0.0])], "node string, score double, v array<double>")
    assert [n for n, _ in retrieval.diverse_greedy(df, 8, 0.5)] == retrieval.diverse_topk(rows, 8, 0.5)
    assert retrieval.diverse_greedy(df.where("node = 'q'"), 3, 0.5) == []


def test_kappa(spark):
    rows = [(i, r) for i, rs in enumerate(["xxx", "xxy", "yyy", "xyy"]) for r in rs]
    df = spark.createDataFrame(rows, "item int, r string")
    assert metrics.fleiss_kappa(df, "item", "r").first().kappa == pytest.approx(1 / 3, abs=1e-6)
    assert metrics.fleiss_kappa(df.limit(5), "item", "r").first().kappa is None


def test_text_columns(spark):
    df = spark.createDataFrame([("  The  cat. The DOG! 1,2 ",), ("",)], "t string")
    t = F.col("t")
    r = df.select(X.collapse_blanks(t).alias("c"), X.word_count(t).alias("w"), X.sentence_count(t).alias("s"), X.unique_word_ratio(t).alias("u"), X.uppercase_ratio(t).alias("p"), X.slug(t).alias("g")).collect()
    assert r[0].c == "The cat. The DOG! 1,2" and r[0].w == 5 and r[0].s == 2 and r[0].u == 0.8 and r[0].g == "the_cat_the_dog_1_2"
    assert (r[1].w, r[1].s, r[1].u, r[1].p) == (0, 1, 0.0, 0.0)


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "2", " ", -1.0), (1, "x", "b", 2.0), (2, "3", None, 3.0)], "k int, n string, b string, v double")
    assert cleaning.negative_to_null(df, ["v"]).where("v is null").count() == 1
    assert cleaning.blank_to_null(df, ["b"]).where("b is null").count() == 2
    assert dict(cleaning.to_numbers(df, ["n", "b"]).dtypes)["n"] == "double"
    assert {(r.k, r.n) for r in cleaning.keep_first(df, ["k"], ["v"]).collect()} == {(1, "2"), (2, "3")}
    assert cleaning.select_columns(["Q1", "Q2", "x"], ["^Q"], ["2"]) == ["Q1"]
    assert cleaning.derive_key(df, ["k", "b"], "z").where("z is null").count() == 1


def test_near_pairs_have_no_cap(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.ones((12, 8)) + rng.normal(0, 0.05, (12, 8)), rng.normal(size=(60, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)] + [(99, None)], "item_id long, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    s = (unit @ unit.T + 1) / 2
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.65}
    for block in (1000, 7):
        got = [(r.item_a, r.item_b) for r in retrieval.near_pairs(df, 0.65, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_heavy_keys_of_large_values_keep_their_spread(spark):
    df = spark.range(4000).select(F.lit("heavy").alias("k"), F.col("id").alias("o"), "id", (F.lit(1e9) + F.col("id") % 10).alias("v"))
    got = per_key(df, "k", "o", "id", "v", partitions=9).first()
    assert got.std_value == pytest.approx((8.25 * 4000 / 3999) ** 0.5, rel=1e-9) and got.mean_value == pytest.approx(1e9 + 4.5, rel=1e-12)


def test_cosine_search_in_blocks(spark):
    from ouzel.operators.retrieval import cosine_topk

    v = spark.range(60).select(F.col("id").alias("item_id"), F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3))).alias("v"))
    q = v.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), "v")
    whole, cut = ({tuple(r) for r in cosine_topk(q, v, 3, most_queries=m).collect()} for m in (1000, 7))
    assert whole == cut and len(cut) == 90


def test_levels_pooled_beyond_the_report(spark):
    from ouzel.operators.levels import collapse_rare, kept_levels

    df = spark.range(3000).select(F.when(F.col("id") < 1000, "big").otherwise(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("c"))
    kept, names, n = kept_levels(df, "c")
    assert (kept, len(names), names[0], n) == (["big"], 200, "r1000", 2000)
    assert {(r.c, r["count"]) for r in collapse_rare(df, "c")[0].groupBy("c").count().collect()} == {("big", 1000), ("Other", 2000)}
