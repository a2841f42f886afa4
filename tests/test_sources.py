import gzip
import json

from ouzel.plans.planner import Engine
from ouzel.sources import readers
from ouzel.streaming import moments

BOOK = """SOCIAL VALUES
Q1: Importance of family
How important is family in your life?
1 Very important
2 Rather important
-1 Do not know
Q2 Trust in people
1. yes
2. no
Q1: second card is ignored
"""


def test_reviews_and_products(spark, tmp_path):
    rows = [
        {"asin": "A", "reviewerID": "R", "overall": 5.0, "vote": "1,234", "verified": True, "image": ["u"], "style": {"Format:": " Paperback"}, "unixReviewTime": 1514764800, "reviewText": "Good  book! Really.", "summary": "Five"},
        {"asin": "A", "reviewerID": None, "overall": 1.0, "reviewText": None},
    ]
    path = str(tmp_path / "r.json.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    r = readers.reviews(readers.read_json_lines(spark, path, readers.REVIEW)).orderBy("rating").collect()
    assert len(r) == 2 and r[1].helpful_votes == 1234 and r[1].review_year == 2018 and r[1].review_date == "2018-01-01" and r[1].product_format == "Paperback" and r[1].has_image == 1
    assert r[0].review_word_count == 0 and r[0].review_sentence_count == 1 and r[0].helpful_votes == 0
    meta = [{"asin": "A", "title": "T", "price": "$12.99", "category": '["Books", "Art"]', "rank": "#1,234 in Books (", "also_buy": ["x"], "main_cat": "Books"}, {"asin": "A", "title": "U", "main_cat": "Books"}, {"asin": "B", "main_cat": "Toys"}]
    mp = tmp_path / "m.json"
    mp.write_text("\n".join(map(json.dumps, meta)))
    p = readers.products(readers.read_json_lines(spark, str(mp), readers.PRODUCT), "Books").collect()
    assert len(p) == 1 and p[0].product_price == 12.99 and p[0].product_main_category == "Books" and p[0].product_sub_category == "Art" and p[0].product_sales_rank == 1234 and p[0].product_also_buy_count == 1


def test_codebook(spark, tmp_path):
    (tmp_path / "c.txt").write_text(BOOK)
    cards = {r.var_name: r for r in readers.codebook(spark, str(tmp_path / "c.txt")).collect()}
    assert cards["Q1"].label == "Importance of family" and [o.code for o in cards["Q1"].options] == ["1", "2"] and cards["Q1"].missing_codes == {"-1": "Do not know"} and cards["Q1"].module == "Social Values"
    df = readers.codebook(spark, str(tmp_path / "c.txt"))
    readers.write_cards(df, str(tmp_path / "cards"))
    back = readers.read_cards(spark, str(tmp_path / "cards"))
    assert back.count() == 2 and {r.kind for r in readers.infer_scale(back).collect()} == {"binary"}


def test_graph_document(spark, tmp_path):
    doc = {"insights": [{"id": "a", "sentence": "s", "created_at": "2024-01-01T00:00:00"}, {"id": "b"}], "relations": [{"source_id": "b", "target_id": "a", "relation_type": "supports"}, {"source_id": "b", "target_id": "a", "relation_type": "similar_to"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    from ouzel.operators.graph import load_relations

    i, r = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert [x.relation_type for x in load_relations(r, i).collect()] == ["extends"]
    readers.write_graph(i, r, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/insights")).count() == 2


def test_optional_and_csv(spark, tmp_path):
    assert readers.optional_table(spark, str(tmp_path / "none"), "a int").count() == 0
    readers.append_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "c"))
    readers.append_csv(spark.createDataFrame([(2, "y")], "a int, b string"), str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), "a int, b string").count() == 2
    log = readers.RunLog(str(tmp_path / "run"), seed=1)
    log.event("start", n=2)
    assert len(log.digest(str(tmp_path / "run/events.jsonl"))) == 64


def test_stream_moments_match_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i), float((i * 7) % 11)) for i in range(300)], "g int, x double, y double")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = moments.read_stream(spark, str(tmp_path / "in"), df.schema, 2)
    moments.keep_moments(stream, "g", "x", "y", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    state = spark.read.parquet(str(tmp_path / "out"))
    assert state.select("batch").distinct().count() > 1
    got = {r.g: r.r for r in moments.read_out(moments.combine(state, "g"), "g").collect()}
    want = {r.g: r.r for r in moments.read_out(moments.moments(df, "g", "x", "y"), "g").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    one = Engine(df.where("g = 0").select("x", "y")).run("assoc(x, y)").first()
    assert abs(one.effect_size - want[0]) < 1e-9
