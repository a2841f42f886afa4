"""Joins, aggregations, windows, sampling and set operations of the feature pipelines."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..operators import cleaning, levels, metrics, profiling
from ..session import table

R = "amazon_books_autokd"


def inner_join(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where(F.year("o_orderdate").between(1995, 1996))
    return o.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def feature_assembly(s: SparkSession, d: str) -> DataFrame:
    """A base with several aggregated sides, each reduced to one row per key before its left join."""
    base = table(s, d, "customer").select("c_custkey", "c_nationkey")
    o = table(s, d, "orders")
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("max_price"))
    open_ = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n_open"))
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    quantity = o.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("q").alias("quantity"))
    x = base
    for side in (counts, open_, quantity):
        x = x.join(side.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    x = x.join(F.broadcast(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey", "left")  # 25 rows
    return x.select("c_custkey", "n_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orders", "n_open")), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.round(F.log1p(F.coalesce("max_price", F.lit(0.0))), 6).alias("log_price"))


def left_join_pred(s: SparkSession, d: str) -> DataFrame:
    """A predicate of the right side's alone: filter it first."""
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(s, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("n").alias("with_urgent"), F.coalesce(F.sum("n"), F.lit(0)).alias("urgent"))


def composite_join(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "lineitem")
    pairs = i.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    back = i.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("returned"))
    return pairs.join(back, ["l_partkey", "l_suppkey"], "left").select("l_partkey", "l_suppkey", "n", F.coalesce("returned", F.lit(0)).alias("returned"))


def semi_join(s: SparkSession, d: str) -> DataFrame:
    big = table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def membership_flag(s: SparkSession, d: str) -> DataFrame:
    seen = table(s, d, "field_agg").select("paperid").distinct().withColumn("has_field", F.lit(1))
    return table(s, d, "cite_agg").select("paperid").distinct().join(seen, "paperid", "left").groupBy(F.coalesce("has_field", F.lit(0)).alias("has_field")).agg(F.count("*").alias("n"))


def double_dim_join(s: SparkSession, d: str) -> DataFrame:
    """One dimension joined for two roles."""
    n = table(s, d, "nation")
    supplier = F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation")))
    customer = F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")))
    i = table(s, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    x = i.join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(supplier, "s_nationkey").join(customer, "c_nationkey").groupBy("supplier_nation", "customer_nation").agg(F.count("*").alias("n"))


def preagg_join(s: SparkSession, d: str) -> DataFrame:
    """Greatest values over a join of two many-sides, from each side's greatest."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_price"))
    e = table(s, d, "events").groupBy("user_id").agg(F.max("value").alias("max_value"))
    return o.join(e, F.col("o_custkey") == F.col("user_id")).select("o_custkey", "max_price", "max_value")


def distinct_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Papers loaded twice: the later load stays."""
    c = table(s, d, "cite_agg")
    last = c.groupBy("paperid").agg(F.max("loaded_on").alias("loaded_on"), F.count("*").alias("loads"))
    return last.groupBy("loads").agg(F.count("*").alias("papers"), F.max("loaded_on").alias("last_load"))


def review_enrich(s: SparkSession, d: str) -> DataFrame:
    """Reviews with counts and means of their reviewer and product, aggregated once each."""
    r = table(s, d, R).where("reviewerid is not null and asin is not null").select("review_id", "reviewerid", "asin", "rating")
    who = r.groupBy("reviewerid").agg(F.count("*").alias("reviewer_n"), F.round(F.avg("rating"), 2).alias("reviewer_mean"))
    what = r.groupBy("asin").agg(F.count("*").alias("product_n"), F.round(F.avg("rating"), 2).alias("product_mean"))
    return r.join(who, "reviewerid").join(what, "asin").select("review_id", "reviewer_n", "reviewer_mean", "product_n", "product_mean")


def reviewer_agg(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).where("reviewerid is not null").groupBy("reviewerid").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 2).alias("mean_rating"), F.round(F.stddev_pop("rating"), 2).alias("std_rating"))


def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).groupBy("product_main_category").agg(F.count("*").alias("n"), F.count_distinct("asin").alias("products"), F.count_distinct("reviewerid").alias("reviewers"))


def filtered_agg(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).groupBy("product_format").agg(
        F.expr("count(distinct asin) filter (where rating >= 4)").alias("liked"), F.expr("count(*) filter (where helpful_votes > 0)").alias("voted"), F.expr("count(distinct reviewerid) filter (where verified_purchase = 1)").alias("buyers")
    )


def cond_agg(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).groupBy("review_year").agg(F.sum(F.when(F.col("rating") == 5, 1).otherwise(0)).alias("five_stars"), F.max(F.when(F.col("has_image") == 1, 1).otherwise(0)).alias("any_image"), F.sum(F.when(F.col("helpful_votes") >= 10, F.col("helpful_votes")).otherwise(0)).alias("strong_votes"))


def ref_age_stats(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "lineitem").groupBy("l_suppkey")
    return i.agg(F.round(F.avg("l_quantity"), 4).alias("mean_q"), F.median("l_quantity").alias("median_q"), F.round(F.stddev_samp("l_quantity"), 4).alias("std_q"), (F.max("l_quantity") - F.min("l_quantity")).alias("span_q"), F.round(F.try_divide(F.sum(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)), F.count("*")), 4).alias("share_large"))


def primary_dim(s: SparkSession, d: str) -> DataFrame:
    """The attribute of the best row of each key, ties by name."""
    best = F.max(F.struct("primary_field_score", "primary_field_name")).alias("x")
    f = table(s, d, "field_agg").where("primary_field_name is not null and primary_field_score is not null")
    return f.groupBy("num_fields").agg(best).select("num_fields", F.col("x.primary_field_name").alias("field"), F.col("x.primary_field_score").alias("score"))


def group_share(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "field_agg").groupBy("primary_field_name").agg(F.count("*").alias("n"))
    return f.select("primary_field_name", "n", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))  # over a row per field


def top1_per_key(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return i.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_linenumber", "l_extendedprice")


def stratified_take(s: SparkSession, d: str) -> DataFrame:
    x = levels.stratified_take(table(s, d, R).select("rating", "review_id"), "rating", "review_id", 0.1, seed=3)
    return x.groupBy("rating").agg(F.count("*").alias("taken"))


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """A tenth of every rating, at least 50 rows (or all there are)."""
    return levels.stratified_take(table(s, d, R).select("rating", "review_id"), "rating", "review_id", 0.1, seed=4, least=50).groupBy("rating").agg(F.count("*").alias("taken"))


def sample_hash_topn(s: SparkSession, d: str) -> DataFrame:
    """A uniform sample of fixed size that doesn't depend on partitions: the least hashes."""
    return table(s, d, R).select("review_id", "asin", "rating").orderBy(F.xxhash64(F.lit(11), "review_id"), "review_id").limit(500)


def split_70_30(s: SparkSession, d: str) -> DataFrame:
    a, b = levels.split(table(s, d, R).select("review_id", "rating"), "review_id", 0.7, "rating", seed=5)
    return a.withColumn("part", F.lit("first")).unionAll(b.withColumn("part", F.lit("second"))).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 4).alias("mean_rating"))


def topk_groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "field_agg").where("primary_field_name is not null").groupBy("primary_field_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary_field_name").limit(25)


def missing_rates(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, R)
    cols = ["asin", "reviewerid", "helpful_votes", "brand", "title", "review_text", "summary", "review_date", "product_price"]
    return cleaning.missing_rates(r, cols, 0.0).withColumn("missing_rate", F.round("missing_rate", 6))


def prep_report(s: SparkSession, d: str) -> DataFrame:
    """Rows, year span and missing rates above one percent, as name and value."""
    r = table(s, d, R)
    one = r.agg(F.count("*").cast("double").alias("rows"), F.min("review_year").cast("double").alias("first_year"), F.max("review_year").cast("double").alias("last_year"), F.count_distinct("asin").cast("double").alias("products"))
    head = one.unpivot([], one.columns, "name", "value")
    rates = cleaning.missing_rates(r, ["brand", "title", "review_text", "helpful_votes", "reviewerid"], 0.01).select(F.concat(F.lit("missing_"), "column").alias("name"), F.col("missing_rate").alias("value"))
    return head.unionAll(rates).select("name", F.round("value", 6).alias("value"))


def distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).select("product_main_category", "product_sub_category", "product_format").distinct()


def keep_first(s: SparkSession, d: str) -> DataFrame:
    """Re-delivered rows: the first ingested of each content."""
    r = table(s, d, R).where("asin is not null and reviewerid is not null and review_unix is not null").select("asin", "reviewerid", "review_unix", "ingested_at", "review_id", "rating")
    return cleaning.keep_first(r, ["asin", "reviewerid", "review_unix"], ["ingested_at", "review_id"])


def column_profile(s: SparkSession, d: str) -> DataFrame:
    x = profiling.column_profile(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag", "l_linenumber", "l_extendedprice"])
    return x.withColumns({"mean_value": F.round("mean_value", 4), "mean_length": F.round("mean_length", 4)})


def schema_desc(s: SparkSession, d: str) -> DataFrame:
    return profiling.describe_schema(table(s, d, R), ["rating", "helpful_votes", "verified_purchase", "product_format", "review_text", "review_year", "product_price"]).select("column", "kind", "n_distinct", "warning")


def top_values(s: SparkSession, d: str) -> DataFrame:
    return profiling.top_values(table(s, d, R), ["product_format", "product_main_category", "rating", "review_year"])


MODULES = {"rating": "engagement", "helpful_votes": "engagement", "has_image": "engagement", "review_word_count": "text", "review_avg_word_length": "text", "review_unique_word_ratio": "text", "review_uppercase_ratio": "text", "product_price": "product", "product_sales_rank": "product", "product_review_count": "product", "reviewer_review_count": "reviewer"}


def module_stats(s: SparkSession, d: str) -> DataFrame:
    return profiling.module_stats(table(s, d, R), MODULES).withColumns({c: F.round(c, 6) for c in ("mean", "std", "missing")})


def substantive_cols(s: SparkSession, d: str) -> DataFrame:
    skip = ["review_id", "asin", "reviewerid", "review_text", "summary", "title", "ingested_at"]
    return profiling.substantive(table(s, d, R), skip).withColumns({"numeric_share": F.round("numeric_share", 6), "missing_share": F.round("missing_share", 6)})


def level_counts(s: SparkSession, d: str) -> DataFrame:
    return levels.level_counts(table(s, d, R), "product_format")


def win_rate(s: SparkSession, d: str) -> DataFrame:
    return metrics.win_rate(_ratings(s, d))


def _ratings(s: SparkSession, d: str) -> DataFrame:
    """Judgements derived from reviews by fixed arithmetic, as the tables hold none."""
    k = F.col("review_id")
    return table(s, d, R).select(
        F.when(k % 3 == 0, "books").otherwise("papers").alias("dataset"), F.when(k % 5 < 2, "human").otherwise("model").alias("rater_group"), F.when(k % 2 == 0, "novelty").otherwise("validity").alias("dimension"),
        F.when((k * 7) % 11 < 5, "system").when((k * 7) % 11 < 9, "gold").otherwise("tie").alias("winner"), F.floor(k / 4).alias("item"),
    )


def fleiss_kappa(s: SparkSession, d: str) -> DataFrame:
    r = _ratings(s, d)
    whole = r.groupBy("item").agg(F.count("*").alias("n")).where("n = 4").select("item")
    return metrics.fleiss_kappa(r.join(whole, "item"), "item", "winner")


_RATINGS_SQL = f"""SELECT CASE WHEN review_id % 3 = 0 THEN 'books' ELSE 'papers' END AS dataset, CASE WHEN review_id % 5 < 2 THEN 'human' ELSE 'model' END AS rater_group,
 CASE WHEN review_id % 2 = 0 THEN 'novelty' ELSE 'validity' END AS dimension, CASE WHEN (review_id * 7) % 11 < 5 THEN 'system' WHEN (review_id * 7) % 11 < 9 THEN 'gold' ELSE 'tie' END AS winner, review_id // 4 AS item FROM {R}"""

_SKIP_SQL = ["verified_purchase", "has_image", "product_format", "review_year", "review_date", "review_unix", "brand", "product_price", "product_main_category", "product_sub_category", "product_sales_rank", "product_also_buy_count", "product_also_view_count", "product_has_description", "reviewer_review_count", "reviewer_avg_rating", "reviewer_rating_std", "product_review_count", "product_avg_rating", "product_rating_std", "review_length", "review_word_count", "review_sentence_count", "review_avg_word_length", "review_unique_word_ratio", "review_exclamation_count", "review_question_count", "review_uppercase_ratio", "summary_length", "summary_word_count", "review_has_exclamation", "review_has_question", "rating", "helpful_votes"]
_TEXTS = {"product_format", "review_date", "brand", "product_main_category", "product_sub_category"}

_profile_sql = lambda c, num: f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, " + (f"min({c})::double AS min_value, max({c})::double AS max_value, round(avg({c}), 4) AS mean_value, NULL::double AS mean_length" if num else f"NULL::double AS min_value, NULL::double AS max_value, NULL::double AS mean_value, round(avg(length({c})), 4) AS mean_length") + " FROM lineitem"

_chosen = [(m, c) for m in sorted(set(MODULES.values())) for c in sorted(k for k, v in MODULES.items() if v == m)[:5]]

SQL = {
    "inner_join": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1995 AND 1996 GROUP BY 1",
    "feature_assembly": """SELECT c_custkey, n_name, coalesce(n_orders, 0) AS n_orders, coalesce(n_open, 0) AS n_open, coalesce(quantity, 0.0)::double AS quantity, round(ln(coalesce(max_price, 0) + 1), 6) AS log_price
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON c_custkey = b.o_custkey
        LEFT JOIN (SELECT o_custkey, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) q ON c_custkey = q.o_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "left_join_pred": "SELECT c_mktsegment, count(*) AS customers, count(n) AS with_urgent, coalesce(sum(n), 0)::bigint AS urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON c_custkey = o_custkey GROUP BY 1",
    "composite_join": "SELECT l_partkey, l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2",
    "semi_join": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1",
    "membership_flag": "SELECT CASE WHEN f.paperid IS NULL THEN 0 ELSE 1 END AS has_field, count(*) AS n FROM (SELECT DISTINCT paperid FROM cite_agg) c LEFT JOIN (SELECT DISTINCT paperid FROM field_agg) f USING (paperid) GROUP BY 1",
    "double_dim_join": "SELECT a.n_name AS supplier_nation, b.n_name AS customer_nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1, 2",
    "preagg_join": "SELECT o_custkey, max_price, max_value FROM (SELECT o_custkey, max(o_totalprice) AS max_price FROM orders GROUP BY 1) JOIN (SELECT user_id, max(value) AS max_value FROM events GROUP BY 1) ON o_custkey = user_id",
    "distinct_dedupe": "SELECT loads, count(*) AS papers, max(loaded_on) AS last_load FROM (SELECT paperid, count(*) AS loads, max(loaded_on) AS loaded_on FROM cite_agg GROUP BY 1) GROUP BY 1",
    "review_enrich": f"WITH r AS (SELECT review_id, reviewerid, asin, rating FROM {R} WHERE reviewerid IS NOT NULL AND asin IS NOT NULL) SELECT review_id, w.n AS reviewer_n, w.m AS reviewer_mean, p.n AS product_n, p.m AS product_mean FROM r JOIN (SELECT reviewerid, count(*) AS n, round(avg(rating), 2) AS m FROM r GROUP BY 1) w USING (reviewerid) JOIN (SELECT asin, count(*) AS n, round(avg(rating), 2) AS m FROM r GROUP BY 1) p USING (asin)",
    "reviewer_agg": f"SELECT reviewerid, count(*) AS n, round(avg(rating), 2) AS mean_rating, round(stddev_pop(rating), 2) AS std_rating FROM {R} WHERE reviewerid IS NOT NULL GROUP BY 1",
    "distinct_counts": f"SELECT product_main_category, count(*) AS n, count(DISTINCT asin) AS products, count(DISTINCT reviewerid) AS reviewers FROM {R} GROUP BY 1",
    "filtered_agg": f"SELECT product_format, count(DISTINCT asin) FILTER (rating >= 4) AS liked, count(*) FILTER (helpful_votes > 0) AS voted, count(DISTINCT reviewerid) FILTER (verified_purchase = 1) AS buyers FROM {R} GROUP BY 1",
    "cond_agg": f"SELECT review_year, sum(CASE WHEN rating = 5 THEN 1 ELSE 0 END)::bigint AS five_stars, max(CASE WHEN has_image = 1 THEN 1 ELSE 0 END) AS any_image, sum(CASE WHEN helpful_votes >= 10 THEN helpful_votes ELSE 0 END)::bigint AS strong_votes FROM {R} GROUP BY 1",
    "ref_age_stats": "SELECT l_suppkey, round(avg(l_quantity), 4) AS mean_q, median(l_quantity) AS median_q, round(stddev_samp(l_quantity), 4) AS std_q, max(l_quantity) - min(l_quantity) AS span_q, round(sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)::double / nullif(count(*), 0), 4) AS share_large FROM lineitem GROUP BY 1",
    "primary_dim": "SELECT num_fields, primary_field_name AS field, primary_field_score AS score FROM field_agg WHERE primary_field_name IS NOT NULL AND primary_field_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY num_fields ORDER BY primary_field_score DESC, primary_field_name DESC) = 1",
    "group_share": "SELECT primary_field_name, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (), 6) AS share FROM field_agg GROUP BY 1",
    "top1_per_key": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1",
    "stratified_take": f"SELECT rating, ceil(round(count(*) * 0.1, 9))::bigint AS taken FROM {R} WHERE rating IS NOT NULL GROUP BY 1",
    "stratified_sample": f"SELECT rating, least(count(*), greatest(50, ceil(round(count(*) * 0.1, 9))))::bigint AS taken FROM {R} WHERE rating IS NOT NULL GROUP BY 1",
    "topk_groups": "SELECT primary_field_name, count(*) AS n FROM field_agg WHERE primary_field_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "missing_rates": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM {R}) WHERE missing_rate > 0" for c in ["asin", "reviewerid", "helpful_votes", "brand", "title", "review_text", "summary", "review_date", "product_price"]),
    "prep_report": f"SELECT 'rows' AS name, count(*)::double AS value FROM {R} UNION ALL SELECT 'first_year', min(review_year)::double FROM {R} UNION ALL SELECT 'last_year', max(review_year)::double FROM {R} UNION ALL SELECT 'products', count(DISTINCT asin)::double FROM {R} UNION ALL "
    + " UNION ALL ".join(f"SELECT * FROM (SELECT 'missing_{c}', round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS v FROM {R}) WHERE v > 0.01" for c in ["brand", "title", "review_text", "helpful_votes", "reviewerid"]),
    "distinct": f"SELECT DISTINCT product_main_category, product_sub_category, product_format FROM {R}",
    "keep_first": f"SELECT asin, reviewerid, review_unix, ingested_at, review_id, rating FROM {R} WHERE asin IS NOT NULL AND reviewerid IS NOT NULL AND review_unix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asin, reviewerid, review_unix ORDER BY ingested_at NULLS FIRST, review_id) = 1",
    "column_profile": " UNION ALL ".join(_profile_sql(c, c != "l_returnflag") for c in ["l_quantity", "l_discount", "l_returnflag", "l_linenumber", "l_extendedprice"]),
    "schema_desc": " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", CASE WHEN bool_and({c} IN (0, 1)) AND count(DISTINCT {c}) = 2 THEN 'binary' WHEN bool_and({c} = floor({c})) THEN 'integer' ELSE 'float' END AS kind, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) < 2 THEN 'fewer than two levels' WHEN count(DISTINCT {c}) > 30 THEN 'continuous' END AS warning FROM {R}" for c in ("rating", "helpful_votes", "verified_purchase", "review_year", "product_price")]
        + [f"SELECT '{c}' AS \"column\", CASE WHEN avg(CASE WHEN try_cast({c} AS double) IS NULL THEN 0.0 ELSE 1.0 END) FILTER ({c} IS NOT NULL) >= 0.8 AND count(DISTINCT {c}) <= 50 AND avg(length({c})) <= 6 THEN 'coded' WHEN avg(length({c})) >= 25 THEN 'text' ELSE 'string' END AS kind, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) < 2 THEN 'fewer than two levels' END AS warning FROM {R}" for c in ("product_format", "review_text")]
    ),
    "top_values": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::varchar) AS rank FROM {R} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}::varchar) <= 6" for c in ["product_format", "product_main_category", "rating", "review_year"]),
    "module_stats": " UNION ALL ".join(f"SELECT '{m}' AS module, '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM {R}" for m, c in _chosen),
    "substantive_cols": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN try_cast({c}::varchar AS double) IS NULL THEN 0.0 ELSE 1.0 END), 6) AS numeric_share, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(DISTINCT {c}) AS n_distinct FROM {R}" for c in _SKIP_SQL)
    + ") WHERE missing_share <= 0.9 AND n_distinct >= 2 AND (\"column\" NOT IN (" + ", ".join(f"'{c}'" for c in sorted(_TEXTS)) + ") OR numeric_share >= 0.5)",
    "level_counts": f"SELECT product_format AS level, count(*) AS n FROM {R} WHERE product_format IS NOT NULL GROUP BY 1",
    "win_rate": f"SELECT CASE WHEN grouping(dataset) = 1 THEN 'All' ELSE dataset END AS dataset, CASE WHEN grouping(rater_group) = 1 THEN 'All' ELSE rater_group END AS rater_group, CASE WHEN grouping(dimension) = 1 THEN 'All' ELSE dimension END AS dimension, count(*) AS n, round(avg(CASE WHEN winner = 'system' THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM ({_RATINGS_SQL}) WHERE winner <> 'tie' GROUP BY CUBE (dataset, rater_group, dimension)",
    "fleiss_kappa": f"""WITH r AS (SELECT * FROM ({_RATINGS_SQL}) WHERE item IN (SELECT item FROM ({_RATINGS_SQL}) GROUP BY 1 HAVING count(*) = 4)), c AS (SELECT item, winner, count(*) AS c FROM r GROUP BY 1, 2),
        i AS (SELECT item, sum(c)::double AS n, sum(c * c)::double AS q FROM c GROUP BY 1), p AS (SELECT count(*) AS n_items, max(n)::bigint AS raters, avg((q - n) / (n * (n - 1))) AS p FROM i),
        e AS (SELECT sum(c * c)::double / (sum(c)::double * sum(c)) AS pe FROM (SELECT winner, sum(c)::double AS c FROM c GROUP BY 1))
        SELECT n_items, raters, round((p - pe) / (1 - pe), 6) AS kappa FROM p, e""",
}

QUERIES = {f.__name__: f for f in (inner_join, feature_assembly, left_join_pred, composite_join, semi_join, membership_flag, double_dim_join, preagg_join, distinct_dedupe, review_enrich, reviewer_agg, distinct_counts, filtered_agg, cond_agg, ref_age_stats, primary_dim, group_share, top1_per_key, stratified_take, stratified_sample, sample_hash_topn, split_70_30, topk_groups, missing_rates, prep_report, distinct, keep_first, column_profile, schema_desc, top_values, module_stats, substantive_cols, level_counts, win_rate, fleiss_kappa)}
