import pyspark.sql.functions as F
import math

import numpy as np
import pandas as pd
import pytest

from ouzel.llm import bisection as B
from ouzel.llm import topn

SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]


def _want(v, p):
    v = np.sort(v)
    return v[max(1, math.ceil(round(p * len(v), 9))) - 1]


@pytest.mark.parametrize("tolerance", [0.0, 0.5])
def test_percentiles(spark, tolerance):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=500), "b": np.exp(rng.normal(size=700) * 4), "c": np.array([3.0]), "d": np.repeat([0.0, 5.0], [300, 2]), None: rng.integers(0, 4, 100) * 1.0, "e": np.array([-np.inf, 0.0, 1.0, np.inf, np.inf])}
    rows = [(g, float(x), 1) for g, v in groups.items() for x in v] + [("a", None, 1), ("a", float("nan"), 1), ("z", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    got = {(r.g, r.percentile): r for r in B.percentiles(B.value_counts(df, ["g"], "x"), ["g"], SHARES, tolerance).collect()}
    assert len(got) == len(groups) * len(SHARES)
    for g, v in groups.items():
        for p in SHARES:
            r = got[g, p]
            assert r.n_rows == len(v)
            if tolerance == 0:
                assert r.value == _want(v, p) and r.error_bound == 0
            else:
                assert r.value - r.error_bound <= _want(v, p) <= r.value and r.error_bound <= tolerance


def test_states_combine(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=900)
    parts = [spark.createDataFrame([("g", float(x)) for x in v[i::3]], "g string, x double") for i in range(3)]
    whole = B.combine([B.value_counts(p, ["g"], "x") for p in parts], ["g"])
    assert B.percentiles(whole, ["g"], [0.5]).first().value == _want(v, 0.5)
    coarse = B.combine([B.value_counts(p, ["g"], "x", resolution=0.01) for p in parts], ["g"])
    assert abs(B.percentiles(coarse, ["g"], [0.5]).first().value - _want(v, 0.5)) <= 0.0051
    assert B.percentiles(B.value_counts(spark.createDataFrame([], "g string, x double"), ["g"], "x"), ["g"], SHARES).count() == 0
    with pytest.raises(ValueError):
        B.percentiles(whole.withColumnRenamed("g", "lo"), ["lo"], [0.5])


def test_top_n(spark):
    rng = np.random.default_rng(2)
    n = 8000
    p = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 300, n).astype(str)), "s": rng.integers(-3, 60, n).astype(float), "id": np.arange(n)})
    p.loc[rng.random(n) < 0.1, "s"] = np.nan
    p.loc[::97, "g"] = None
    p.loc[p.g == "hot", "s"] = 7.0  # all equal
    rows = [(r.g, None if math.isnan(r.s) and i % 2 else r.s, r.id, "x") for i, r in enumerate(p.itertuples())]
    df = spark.createDataFrame(rows, "g string, s double, id long, _x string").repartition(6)
    got = {(r.g, r.id, r["rank"]) for r in topn.top_n(df, ["g"], "s", ["id"], 3).collect()}
    q = p.dropna(subset=["s"]).sort_values(["s", "id"], ascending=[False, True])
    q["rank"] = q.groupby("g", dropna=False).cumcount() + 1
    want = {(None if pd.isna(r.g) else r.g, r.id, r.rank) for r in q[q["rank"] <= 3].itertuples()}
    assert got == want


def test_top_n_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id as s", "id")
    plan = topn.top_n(df, ["g"], "s", ["id"], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_top_n_edges(spark):
    df = spark.createDataFrame([], "g string, s int, id int")
    assert topn.top_n(df, ["g"], "s", ["id"], 3).count() == 0
    twice = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 0, 2)], "g string, s int, id int")
    assert [r.id for r in topn.top_n(twice, ["g"], "s", ["id"], 2).collect()] == [1, 1]
    with pytest.raises(ValueError):
        topn.top_n(twice.withColumnRenamed("g", "rank"), ["rank"], "s", ["id"], 2)


def test_resolution_is_in_the_bound(spark):
    values = [0.001, 0.004, 0.0049, 0.012, 0.0151, 0.3333, 7.7777, float("inf")]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    shares = [0.1, 0.25, 0.5, 0.75, 1.0]
    exact = {r.percentile: r.value for r in B.percentiles(B.value_counts(df, ["g"], "v"), ["g"], shares).collect()}
    for r in B.percentiles(B.value_counts(df, ["g"], "v", resolution=0.01), ["g"], shares, resolution=0.01).collect():
        assert r.value == exact[r.percentile] or 0 < abs(r.value - exact[r.percentile]) <= r.error_bound + 1e-12
        assert r.error_bound == (0 if r.value == float("inf") else 0.005)


def test_top_n_beyond_the_limit_of_spark(spark, monkeypatch):
    monkeypatch.setattr(topn, "LIMITED", 5)
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.lit(1.0).alias("s"), "id")
    got = topn.top_n(df, ["g"], "s", ["id"], 7)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") >= 2
    assert {(r.g, r.id, r["rank"]) for r in got.collect()} == {(i % 3, i, i // 3 + 1) for i in range(21)}
