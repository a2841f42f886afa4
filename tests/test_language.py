import numpy as np
import pytest

from ouzel.plans import recipes
from ouzel.plans.grammar import GrammarError, Resolver, Spec, is_query, label_aliases, parse
from ouzel.plans.loop import Session, mode_weights, propose_pairs, refinement_anchors
from ouzel.plans.planner import Engine, prepare
from ouzel.plans.profile import Profile
from ouzel.plans.validator import validate

COLUMNS = ["Q1", "Q2", "age", "income", "w", "country"]


@pytest.mark.parametrize(
    "text,spec",
    [
        ("assoc(Q1, Q2)", Spec("assoc", x="Q1", y="Q2")),
        ("ASSOC( q1 ,Q2 (trust) )", Spec("assoc", x="Q1", y="Q2")),
        ("diff(Q1, by=country)", Spec("diff", y="Q1", group="country")),
        ("diff(Q1, by = country) controlling for age, income", Spec("diff", y="Q1", group="country", controls=("age", "income"))),
        ("interact(Q1 * age -> Q2)", Spec("interact", x="Q1", moderator="age", y="Q2")),
        ("interact(Q1*age->Q2) weights=w", Spec("interact", x="Q1", moderator="age", y="Q2", weight="w")),
        ("heterogeneity(Q2 ~ Q1 | country)", Spec("heterogeneity", y="Q2", x="Q1", group="country")),
        ("assoc([Q1], [Q2]) controlling for [age] weights=[w]", Spec("assoc", x="Q1", y="Q2", controls=("age",), weight="w")),
        ("assoc(Q1, Q2 controlling for age)", Spec("assoc", x="Q1", y="Q2", controls=("age",))),
        ("assoc(Q1, Q2) and more", Spec("assoc", x="Q1", y="Q2")),
    ],
)
def test_parse(text, spec):
    assert parse(text, COLUMNS) == spec


@pytest.mark.parametrize("text", ["", "Q1 rises with Q2", "assoc(Q1)", "assoc(Q1, nothing_like_it)", "diff(Q1)", "assoc(Q1, Q2) controlling for w weights=w"])
def test_rejects(text):
    with pytest.raises(GrammarError):
        parse(text, COLUMNS)


def test_roles_and_detector():
    with pytest.raises(GrammarError):
        parse("assoc(Q1, w)", COLUMNS, weights=frozenset({"w"}))
    assert is_query("diff(a, by = b)") and not is_query("different(a, by=b)") and not is_query("interact(a, b)")


def test_canonical_is_symmetric():
    assert parse("assoc(Q2, Q1) controlling for income, age", COLUMNS).canonical() == parse("assoc(Q1, Q2) controlling for age, income", COLUMNS).canonical()


def test_aliases():
    a = label_aliases({"Q1": "Trust in most people", "Q2": "Trust in courts"})
    find = Resolver(COLUMNS, a)
    assert find.find("trust in courts") == "Q2" and find.find("Trust in most") == "Q1" and find.find("zz") is None
    assert len(find.suggest("incme")) == 5 and find.suggest("incme")[0] == "income"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 1500
    g = rng.integers(0, 3, n)
    x, c = rng.normal(size=n), rng.normal(size=n)
    y = 0.4 * x - 0.3 * c + 0.5 * (g == 2) + 0.3 * x * (g == 1) + rng.normal(size=n)
    b = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x - 0.2)))).astype(int)
    w = rng.random(n) + 0.5
    rows = [(i, float(x[i]), float(c[i]), float(y[i]), "abc"[g[i]], int(b[i]), float(w[i]), int(rng.integers(0, 4)), "t" if b[i] else "f") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, c double, y double, g string, b int, w double, o int, tf string").repartition(5)
    return df, x, c, y, g, b, w


def ols(y, *cols, w=None):
    X = np.column_stack([np.ones(len(y)), *cols])
    s = np.ones(len(y)) if w is None else np.sqrt(w)
    beta, *_ = np.linalg.lstsq(X * s[:, None], y * s, rcond=None)
    r = (y - X @ beta) * s
    df = len(y) - X.shape[1]
    cov = np.linalg.inv((X * s[:, None]).T @ (X * s[:, None])) * (r @ r) / df
    return beta, beta / np.sqrt(np.diag(cov)), df, r @ r


def test_linear_agrees_with_lstsq(data):
    df, x, c, y, g, b, w = data
    e = Engine(df)
    r = e.execute(e.parse("assoc(x, y) controlling for c"))[0]
    _, t, d, _ = ols(y, x, c)
    assert r.effect_size == pytest.approx(t[1] / np.sqrt(t[1] ** 2 + d), rel=1e-9) and r.test_method == "ols"
    r = e.execute(e.parse("assoc(x, y) weights=w"))[0]
    _, t, d, _ = ols(y, x, w=w)
    assert r.effect_size == pytest.approx(t[1] / np.sqrt(t[1] ** 2 + d), rel=1e-9) and r.test_method == "wls"


def test_anova_and_interactions(data):
    df, x, c, y, g, b, w = data
    e = Engine(df)
    d1, d2 = (g == 1) * 1.0, (g == 2) * 1.0
    r = e.execute(e.parse("heterogeneity(y ~ x | g)"))[0]
    full, reduced = ols(y, x, d1, d2, x * d1, x * d2)[3], ols(y, x, d1, d2)[3]
    assert r.effect_size == pytest.approx((reduced - full) / reduced, rel=1e-8)
    f = (reduced - full) / 2 / (full / (len(y) - 6))
    assert r.omnibus["statistic"] == pytest.approx(f, rel=1e-8) and r.omnibus["df_num"] == 2
    r = e.execute(e.parse("interact(x * c -> y)"))[0]
    _, t, d, _ = ols(y, x, c, x * c)
    assert r.effect_size == pytest.approx(t[3] / np.sqrt(t[3] ** 2 + d), rel=1e-8)


def test_dispatch(data):
    df = data[0]
    e = Engine(df)
    method = lambda q: e.execute(e.parse(q))[0].test_method
    assert method("assoc(x, y)") == "pearson"
    assert method("diff(y, by=tf)") == "welch_t"
    assert method("diff(o, by=tf)") == "mann_whitney"
    assert method("diff(y, by=g)") == "kruskal_wallis"
    assert method("diff(y, by=g) controlling for c") == "ols_anova"
    assert method("assoc(g, y)") == "ols_anova"
    assert method("assoc(x, b) controlling for c") == "logit"


def test_logit_finds_the_coefficient(data):
    df, x, *_ = data
    e = Engine(df)
    r = e.execute(e.parse("assoc(x, b) controlling for c"))[0]
    assert r.details["coefficient"] == pytest.approx(0.8, abs=0.2) and r.p_value < 1e-6


def test_logit_separation_fails(spark):
    df = spark.createDataFrame([(float(i), int(i > 50), float(i % 7)) for i in range(100)], "x double, y int, c double")
    row = Engine(df).run("assoc(x, y) controlling for c").first()
    assert row.status == "execution_error" and row.error


def test_partitions_do_not_matter(data):
    df = data[0]
    a, b = (Engine(df.repartition(n)).run("diff(y, by=g)").first() for n in (1, 7))
    assert a.effect_size == pytest.approx(b.effect_size, rel=1e-12)


def test_kruskal_of_two_is_mann_whitney(spark):
    import math

    rng = np.random.default_rng(0)
    v, k = rng.integers(0, 9, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), "ab"[b]) for a, b in zip(v, k)], "v int, g string")
    r = recipes.mann_whitney(df, "v", "g")
    order = np.argsort(v, kind="stable")
    ranks = np.empty(300)
    s = v[order]
    for val in np.unique(v):
        at = np.nonzero(s == val)[0]
        ranks[order[at]] = at.mean() + 1
    assert r.details["u"] == pytest.approx(ranks[k == 1].sum() - (k == 1).sum() * ((k == 1).sum() + 1) / 2)
    assert 0 <= r.p_value <= 1 and math.isfinite(r.effect_size)


def test_prepare_rules(spark):
    rows = [("1", "x", 5.0, "a"), ("2", "y", -1.0, "b"), ("n/a", "z", 3.0, None)] * 10
    df = spark.createDataFrame(rows, "num string, txt string, v double, g string")
    x, levels, n = prepare(df, Spec("diff", y="v", group="g"), Profile(missing_codes=(-1.0,)))
    assert n == 30 and x.count() == 10 and levels == {"g"}
    x, levels, _ = prepare(df, Spec("assoc", x="num", y="v"), Profile())
    assert "num" not in levels and x.count() == 20
    x, levels, _ = prepare(df, Spec("assoc", x="num", y="v"), Profile(categorical=frozenset({"num"})))
    assert "num" in levels and x.count() == 30


def test_replication(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    df = spark.createDataFrame([(i, float(v), float(v + rng.normal()), float(rng.normal())) for i, v in enumerate(a)], "id long, a double, b double, z double")
    e = Engine(df, key="id")
    assert e.replicate("assoc(a, b)") == "replicated"
    assert e.replicate("assoc(a, z)") == "not_replicated"
    assert Engine(df.limit(12), key="id").replicate("assoc(a, b)") in ("not_replicated", "replication_error")


def test_validator(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3), f"t{i}", "ab"[i % 2], 1.0) for i in range(30)], "id long, q1 double, q2 double, text string, land string, w double")
    p = Profile(ids=frozenset({"id"}), texts=frozenset({"text"}), weights=frozenset({"w"}), modules={"q1": "m", "q2": "m"}, derived_pairs=frozenset({frozenset({"q1", "text"})}))
    e = Engine(df, p)
    check = lambda q, **k: validate(e, q, **k)
    assert check("") == ["EMPTY_SENTENCE"]
    assert check("x: assoc(q1, q2)") == ["INVALID_DSL_FORMAT"]
    assert check("assoc(q1, q2 | land)") == ["INVALID_ASSOC_COMPLEX_EXPR"]
    assert check("assoc(q1, q2, land)") == ["INVALID_ASSOC_ARITY"]
    assert "SAME_BATTERY_ASSOC" in check("assoc(q1, q2)")
    assert "TEXT_COLUMN_IN_DSL" in check("diff(q1, by=text)")
    assert check("assoc(id, q1)") == ["INVALID_ID_ROLE"]
    assert check("assoc(q1, q2) weights=q1") == ["INVALID_WEIGHT_ROLE"]
    assert "BARE_COUNTRY_DIFF" in check("diff(q1, by=land)", places=frozenset({"land"}))
    assert check("diff(q1, by=land) controlling for q2", places=frozenset({"land"})) == []


def test_session(data, tmp_path):
    df = data[0]
    s = Session(Engine(df.select("x", "c", "y")), propose_pairs(["x", "c", "y"], batch=4))
    found = s.run(3, place=str(tmp_path / "graph"))
    assert found.count() >= 1 and any(reason == "CROSS_ROUND_DUPLICATE" for _, reason in s.rejected)
    assert refinement_anchors(found).columns == ["query", "score"]
    assert sum(mode_weights(20, 4, 2, 1).values()) == pytest.approx(1)


def test_profile_yaml():
    p = Profile.from_yaml("name: t\nmissing_codes: [-1, -2]\nids: [id]\nderived_pairs: [[a, b]]\nmissing_of: {q: [9]}")
    assert p.codes("q") == (9,) and p.codes("z") == (-1, -2) and p.role("id") == "ids" and frozenset({"a", "b"}) in p.derived_pairs


def test_kendall_and_normality(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5, 80)
    b = a + rng.integers(-2, 3, 80)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    r = recipes.kendall(df, "a", "b")
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    up = np.triu_indices(80, 1)
    c, d = (s[up] > 0).sum(), (s[up] < 0).sum()
    ta, tb = (a[:, None] == a)[up].sum(), (b[:, None] == b)[up].sum()
    n = 80 * 79 / 2
    assert (r.details["concordant"], r.details["discordant"]) == (c, d) and r.effect_size == pytest.approx((c - d) / np.sqrt((n - ta) * (n - tb))) and r.p_value < 0.01
    normal = spark.createDataFrame([(float(x),) for x in rng.normal(size=3000)], "y double")
    assert recipes.jarque_bera(normal, "y").p_value > 0.001 > recipes.jarque_bera(normal.selectExpr("exp(y) as y"), "y").p_value


@pytest.mark.parametrize(
    "state,weights",
    [
        ((20, 4, 2, 1, True), {"explore": 0.3, "refine": 0.6, "conflict": 0.45, "global": 0.075}),  # few chains, conflicts
        ((20, 4, 8, 0, True), {"explore": 0.36, "refine": 0.4, "conflict": 0.09, "global": 0.225}),  # dense, many chains
        ((20, 6, 8, 0, True), {"explore": 0.3, "refine": 0.4, "conflict": 0.09, "global": 0.15}),
        ((20, 4, 6, 0, True), {"explore": 0.3, "refine": 0.4, "conflict": 0.09, "global": 0.15}),  # exactly 0.3
        ((5, 3, 0, 0, True), {"explore": 0.6, "refine": 0.4, "conflict": 0.09, "global": 0.0}),
        ((5, 5, 0, 0, False), {"explore": 0.6, "refine": 0.4, "conflict": 0.09, "global": 0.0}),  # without structure
        ((20, 20, 0, 1, False), {"explore": 0.3, "refine": 0.4, "conflict": 0.45, "global": 0.075}),
        ((0, 0, 0, 3, True), {"explore": 1.0, "refine": 0.0, "conflict": 0.0, "global": 0.0}),
    ],
)
def test_mode_weights(state, weights):
    assert mode_weights(*state) == pytest.approx({k: v / sum(weights.values()) for k, v in weights.items()})
