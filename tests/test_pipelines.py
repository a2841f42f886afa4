import pytest

from ouzel.functions import render
from ouzel.operators import graph
from ouzel.plans import papers
from ouzel.plans.answer import answer
from ouzel.plans.grammar import parse


@pytest.fixture(scope="module")
def star(spark):
    make = spark.createDataFrame
    return {
        "papers": make([(1, 2015, 10, 3), (2, 1900, 5, 1), (3, 2020, None, 0)], "paperid long, year int, citation_count long, reference_count long"),
        "fields": make([(7, "Physics", 0), (8, "Optics", 1), (9, "Biology", 0)], "fieldid long, display_name string, level int"),
        "paper_fields": make([(1, 7, 0.9), (1, 8, 0.99), (1, 9, 0.9), (3, 9, 0.2)], "paperid long, fieldid long, score_openalex double"),
        "authorships": make([(1, "a", "first", "i"), (1, "b", "last", "j"), (1, "c", "middle", "")], "paperid long, authorid string, author_position string, institutionid string"),
        "institutions": make([("i", "DE", "company"), ("j", "FR", "education")], "institution_id string, country_code string, type string"),
        "authors": make([("a", 5, 10, 1.5), ("b", 9, 20, 2.5)], "authorid string, h_index int, productivity int, avg_c10 double"),
        "normalized": make([(1, 7, 1.2), (1, 9, 2.0)], "paperid long, fieldid long, normalized_citations double"),
        "hits": make([(1, 7, 0, 1, 1), (1, 9, 0, 0, 1)], "paperid long, fieldid long, Hit_1pct int, Hit_5pct int, Hit_10pct int"),
        "paper_sources": make([(1, 4, True, None), (1, 5, False, "cc")], "paperid long, sourceid long, is_oa boolean, license string"),
        "sources": make([(4, True), (5, False)], "sourceid long, is_oa boolean"),
        "laureates": make([(3, "x"), (3, "y")], "paperid long, laureateid string"),
        "medical": make([(1,)], "paperid long"),
        "references": make([(1, 2), (1, 4), (1, 12), (1, -1)], "citing_paperid long, year_diff int"),
        "texts": make([(1, "What is light: a study?", '{"in": [1, 4], "x2y": [7]}', "en")], "paperid long, title string, abstract_inverted_index string, language string"),
    }


def test_papers(star):
    x = {r.paperid: r for r in papers.assemble(star).collect()}
    assert set(x) == {1, 3}
    one = x[1]
    assert one.main_field == "Physics" and one.num_fields == 3 and one.num_level0_fields == 2 and one.primary_field_score == 0.9
    assert one.num_authors == 3 and one.num_institutions == 2 and one.num_countries == 2 and one.is_international == 1 and one.primary_country == "DE" and one.has_industry == 1 and one.first_h_index == 5 and one.last_productivity == 20
    assert one.normalized_citation == 2.0 and one.is_hit_5pct == 1 and one.is_oa == 1 and one.has_license == 1 and one.has_laureate == 0 and one.is_medical == 1
    assert one.ref_age_mean == 6 and one.ref_age_median == 4 and one.ref_age_span == 10 and one.share_recent_refs == pytest.approx(2 / 3)
    assert one.abstract_words == 4 and one.title_words == 5 and one.has_question == 1 and one.has_colon == 1 and one.decade == 2010
    assert x[3].has_laureate == 1 and x[3].num_authors == 0 and x[3].log_citation_count == 0


def test_papers_of_one_field_and_report(star):
    x = papers.assemble({k: v for k, v in star.items() if k != "texts"}, level_field="Physics")
    assert [r.paperid for r in x.collect()] == [1]
    assert {r.name: r.value for r in papers.report(x).collect()}["rows"] == 1


def test_sentences():
    cols = ["a", "b", "g", "c", "w"]
    s = lambda q, **k: render.sentence(parse(q, cols), {"a": "income", "g": "region"}, **k)
    assert s("assoc(b, a) controlling for c, g", effect=-0.25, p=0.0, n=9) == "Income moves downward with b, given c and region (p<1e-300, effect=-0.25, n=9)."
    assert "Levels of region" in s("diff(a, by=g)") and "depends on c" in s("interact(b * c -> a)") and "as weight" in s("assoc(a, b) weights=w")
    assert "downward" not in s("assoc(b, a)", effect=-1.0, signed=False)
    assert render.with_labels("Q1 and Q11", {"Q1": "x", "Q11": "y"}) == "x and y"


@pytest.mark.parametrize(
    "text,value",
    [
        ('Sure: ```json\n{"a": [1, 2,],}\n``` done', {"a": [1, 2]}),
        ("{'a': 'b', 'c': True}", {"a": "b", "c": True}),
        ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}),
        ('text [1, 2] more', [1, 2]),
        ('{"a": 1 // note\n}', {"a": 1}),
        ("no data", None),
        ("", None),
    ],
)
def test_json(text, value):
    assert render.find_json(text) == value


def test_lists_codes_and_citations():
    assert render.find_list("1. one\n2) two\n- three") == ["one", "two", "three"] and render.find_list('["a", "b"]') == ["a", "b"]
    assert render.find_code("x\n```python\ny = 1\n```") == "y = 1\n"
    assert [i for i, _ in render.citations("A holds [n1, n2] and [zz].", {"n1", "n2"})] == ["n1", "n2"]
    assert render.question_ranges("Q1-Q45, Q50") == [(1, 45), (50, 50)] and render.question_number("Q12A") == 12


def test_answer(spark):
    f = spark.createDataFrame([("n1", [1.0, 0.0], 0.9), ("n2", [0.9, 0.1], 0.5), ("n3", [0.0, 1.0], 0.9)], "node string, v array<double>, validity double")
    t = spark.createDataFrame([("n1", "One."), ("n2", "Two."), ("n3", "Three.")], "node string, text string")
    e = spark.createDataFrame([("n3", "n1", "extends")], "source_id string, target_id string, relation_type string")
    a = answer("q?", [1.0, 0.0], f, t, e, k=3, seeds=1)
    assert [n for n, _ in a["passages"]] == ["n1", "n3"] and a["faithfulness"] == 1.0 and a["citations"][0][0] == "n1"


def test_anchor(spark):
    s = spark.createDataFrame([("a", False, False, True, True, False), ("b", False, False, False, True, False)], "insight_id string, boundary boolean, depth boolean, isolated boolean, underexplored boolean, saturated boolean")
    assert {graph.choose_anchor(s, k) for k in range(20)} <= {"a", "b"} and graph.choose_anchor(s.where("insight_id = 'z'"), 1) is None


@pytest.fixture(scope="module")
def cards(spark):
    from ouzel.sources.readers import CARD

    rows = [
        ("Q1", "Values", "Family matters", "How important is family?", [("1", "very"), ("2", "rather"), ("3", "not")], {"-1": "unknown"}), ("Q2", "Values", "Friends matter", "", [("1", "yes"), ("2", "no")], None),
        ("Q60", "Trust", "Trust in courts", "", [("1", "a"), ("5", "b"), ("9", "c")], None), ("w", "Technical", "Sampling weight", "", None, None), ("idx", "Values", "An index", "", None, None), (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, CARD)


def test_cards(cards):
    from ouzel.plans import catalog

    k = {r.var_name: r.kind for r in catalog.kinds(cards).collect()}
    assert k == {"Q1": "ordinal", "Q2": "binary", "Q60": "nominal", "w": "technical", "idx": "index", None: "index"}
    names = lambda **a: {r.var_name for r in catalog.candidates(cards, **a).collect()}
    assert names() == {"Q1", "Q2", "Q60"} and names(module="val") == {"Q1", "Q2"} and names(ranges="Q2-Q70") == {"Q2", "Q60"} and names(only=["Q1"]) == {"Q1"}
    lines = {r.var_name: r.line for r in catalog.glossary(cards, 2).collect()}
    assert lines["Q1"] == "Q1: Family matters (1=very; 2=rather; ...)" and lines["w"] == "w: Sampling weight"


def test_choice_of_columns(spark, cards):
    from ouzel.plans import catalog

    needs = spark.createDataFrame([("n", "trust in courts and family")], "query_id string, text string")
    rows = catalog.choose_columns(cards, needs, always=["w"], covariates=["Q2"], stop=["in", "and"]).orderBy("rank").collect()
    assert [(r.var_name, r.reason) for r in rows] == [("w", "always"), ("Q60", "module"), ("Q1", "module"), ("Q2", "covariate")]


def test_hashed_vectors(spark):
    from ouzel.operators.retrieval import hashed_vectors

    d = spark.createDataFrame([(1, "red lamp old map"), (2, "red lamp old map"), (3, "quite other words here"), (4, None), (5, "")], "doc_id int, text string")
    v = {r.doc_id: r.v for r in hashed_vectors(d, 64, []).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert cos(1, 2) == pytest.approx(1) and abs(cos(1, 3)) < 0.8 and not any(v[4]) and len(v[5]) == 64


def test_feasible_and_audit(spark):
    from ouzel.plans.planner import Engine
    from ouzel.plans.profile import Profile

    df = spark.createDataFrame([(i, float(i), "x", f"l{i}") for i in range(200)], "id int, y double, one string, many string")
    e = Engine(df, Profile(missing_codes=(-1.0,), high_means={"y": "less"}))
    assert "fewer than two" in e.feasible("diff(y, by=one)") and "no two of 30" in e.feasible("diff(y, by=many)") and e.feasible("assoc(id, y)") is None
    sql = e.audit("assoc(id, y)")
    df.createOrReplaceTempView("data")
    assert spark.sql(sql).count() == 200 and e.cautious(e.parse("assoc(id, y)"))
    assert "direction_requires_codebook_interpretation" in e.run("assoc(id, y)").first().review_flags
