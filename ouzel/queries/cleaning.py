"""Cleaning and text features."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators import cleaning, levels
from ..plans.grammar import Spec
from ..plans.planner import clean_infinite, prepare
from ..plans.profile import Profile
from ..session import table

R = "amazon_books_autokd"


def clean_inf(s: SparkSession, d: str) -> DataFrame:
    return clean_infinite(table(s, d, "cite_agg").select("loaded_on", "normalized_citation")).groupBy("loaded_on").agg(F.count("*").alias("n"), F.count("normalized_citation").alias("known"), F.round(F.max("normalized_citation"), 6).alias("greatest"))


def missingness(s: SparkSession, d: str) -> DataFrame:
    cols = ["normalized_citation", "is_hit_1pct", "loaded_on"]
    return cleaning.missing_rates(clean_infinite(table(s, d, "cite_agg")), cols).withColumn("missing_rate", F.round("missing_rate", 6))


def recode_missing(s: SparkSession, d: str) -> DataFrame:
    """A rating of 0 stands for none."""
    return cleaning.recode_missing(table(s, d, R).select("review_year", "rating"), {"rating": [0.0]}).groupBy("review_year").agg(F.count("*").alias("n"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 6).alias("mean_rating"))


def neg_to_null(s: SparkSession, d: str) -> DataFrame:
    x = cleaning.negative_to_null(table(s, d, "customer"), ["c_acctbal"])
    return x.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("kept"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


def blank_null(s: SparkSession, d: str) -> DataFrame:
    x = cleaning.blank_to_null(table(s, d, R).select("asin", "brand", "summary", "title"), ["asin", "brand", "summary", "title"])
    return x.agg(*(F.count(c).alias(f"n_{c}") for c in x.columns))


def derive_key(s: SparkSession, d: str) -> DataFrame:
    return cleaning.derive_key(table(s, d, R).select("review_id", "product_format", "review_year"), ["product_format", "review_year"], "survey_id").groupBy("survey_id").agg(F.count("*").alias("n"))


def low_info_cols(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, R)
    cols = ["rating", "product_main_category", "product_has_description", "has_image", "helpful_votes", "product_price"]
    return cleaning.low_information(cleaning.column_stats(x, cols)).withColumn("missing_share", F.round("missing_share", 6))


def thin_columns(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, R)
    stats = cleaning.column_stats(x, [c for c in x.columns if c.startswith(("review_", "product_", "reviewer_")) and c != "review_text"])
    return cleaning.thin(stats, ["product_format"], cap=12).select("column", "required", F.round("missing_share", 6).alias("missing_share"), "n_distinct")


def int_to_cat(s: SparkSession, d: str) -> DataFrame:
    x = cleaning.small_integers_to_text(table(s, d, R).select("rating", "has_image", "helpful_votes"), ["rating", "has_image", "helpful_votes"])
    return x.groupBy("rating", "has_image").agg(F.count("*").alias("n"), F.sum("helpful_votes").alias("votes"))


def numeric_shares(s: SparkSession, d: str) -> DataFrame:
    return cleaning.numeric_share(table(s, d, R), ["review_date", "product_format", "brand", "summary"]).withColumn("share", F.round("share", 6))


def collapse_rare(s: SparkSession, d: str) -> DataFrame:
    """Brands with fewer than 30 reviews, and those after the 79 most frequent, as one."""
    return levels.collapse_rare_join(table(s, d, R).select("brand"), "brand").groupBy("brand").agg(F.count("*").alias("n"))


def guard_levels(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, R).agg(*(F.count_distinct(c).alias(c) for c in ("brand", "product_format", "rating")))
    return x.unpivot([], x.columns, "column", "levels").withColumn("allowed", F.col("levels") <= levels.MAX_LEVELS)


def is_binary(s: SparkSession, d: str) -> DataFrame:
    cols = ["has_image", "verified_purchase", "rating", "helpful_votes"]
    x = table(s, d, R).agg(*(F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in cols))
    return x.unpivot([], cols, "column", "binary")


def prep_spec(s: SparkSession, d: str) -> DataFrame:
    """Rows that an association of votes and price by format can use, when 0 votes stand for none."""
    spec = Spec("heterogeneity", x="product_price", y="helpful_votes", group="product_format")
    x, _, rows = prepare(table(s, d, R), spec, Profile(missing_of={"helpful_votes": (0.0,)}))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("helpful_votes"), 6).alias("mean_votes"), F.round(F.avg("product_price"), 6).alias("mean_price"), F.count_distinct("product_format").alias("levels"), F.lit(rows).cast("long").alias("n_before"))


def text_norm(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.collapse_blanks(F.col("text"))).alias("digest"))


def scrub_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).where("review_text is not null").select("review_id", F.length(T.scrub(F.col("review_text"))).alias("n"), F.md5(T.scrub(F.col("review_text"))).alias("digest"))


def text_features(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(t).alias("chars"), T.word_count(t).alias("words"), T.sentence_count(t).alias("sentences"))


def lexical(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", T.mean_word_length(t).alias("mean_length"), T.unique_word_ratio(t).alias("unique_ratio"))


def punct(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").where("text is not null").select(
        "doc_id", T.sign_count(t, "!").alias("exclamations"), T.sign_count(t, "?").alias("questions"), T.uppercase_ratio(t).alias("uppercase"), (T.sign_count(t, "!") > 0).cast("int").alias("has_exclamation")
    )


def parse_num(s: SparkSession, d: str) -> DataFrame:
    """Counts written with thousands separators, and prices with a sign, read back."""
    o = table(s, d, "orders").select("o_orderkey", F.format_number(F.col("o_orderkey") * 1000, 0).alias("a"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" USD")).alias("b"))
    return o.select("o_orderkey", T.parse_count(F.col("a")).alias("n"), T.parse_price(F.col("b")).alias("price"), T.parse_rank(F.concat(F.lit("#"), "a", F.lit(" in Books (See 100)"))).alias("rank"))


def json_int_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", T.json_number_count(F.col("props")).alias("numbers"), F.get_json_object("props", "$.k").alias("k"))


def title_features(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).where("title is not null").select("review_id", *(c.alias(k) for k, c in T.title_features(F.col("title")).items()))


def log_features(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).select("review_id", F.round(F.log1p(F.coalesce("helpful_votes", F.lit(0)).cast("double")), 6).alias("log_votes"), F.greatest(F.coalesce("product_also_buy_count", F.lit(0)), F.coalesce("product_also_view_count", F.lit(0))).alias("also"))


def decade(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).groupBy(T.decade(F.col("review_year")).alias("decade")).agg(F.count("*").alias("n"))


def slug(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, R).where("brand is not null").select(T.slug(F.col("brand")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


def epoch_dates(s: SparkSession, d: str) -> DataFrame:
    """Epoch seconds as year and date, in UTC."""
    t = F.timestamp_seconds("review_unix")
    return table(s, d, R).where("review_unix is not null").groupBy(F.year(t).alias("year"), F.date_format(t, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_SCRUB = "regexp_replace(review_text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')"
_COLS = ["review_id", "review_year", "review_date", "review_unix", "review_length", "review_word_count", "review_sentence_count", "review_avg_word_length", "review_unique_word_ratio", "review_exclamation_count", "review_question_count", "review_uppercase_ratio", "review_has_exclamation", "review_has_question", "product_format", "product_price", "product_main_category", "product_sub_category", "product_sales_rank", "product_also_buy_count", "product_also_view_count", "product_has_description", "product_review_count", "product_avg_rating", "product_rating_std", "reviewer_review_count", "reviewer_avg_rating", "reviewer_rating_std"]
_stats_sql = lambda cols: " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(DISTINCT {c}) AS n_distinct FROM {R}" for c in cols)
_CITE = "SELECT *, CASE WHEN isfinite(normalized_citation) THEN normalized_citation END AS v FROM cite_agg"

SQL = {
    "clean_inf": f"SELECT loaded_on, count(*) AS n, count(v) AS known, round(max(v), 6) AS greatest FROM ({_CITE}) GROUP BY 1",
    "missingness": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM ({_CITE})" for c, e in (("normalized_citation", "v"), ("is_hit_1pct", "is_hit_1pct"), ("loaded_on", "loaded_on"))),
    "recode_missing": f"SELECT review_year, count(*) AS n, count(nullif(rating, 0)) AS rated, round(avg(nullif(rating, 0)), 6) AS mean_rating FROM {R} GROUP BY 1",
    "neg_to_null": "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS kept, round(avg(c_acctbal) FILTER (c_acctbal >= 0), 4) AS mean_balance FROM customer GROUP BY 1",
    "blank_null": f"SELECT count(*) FILTER (trim(asin) <> '') AS n_asin, count(*) FILTER (trim(brand) <> '') AS n_brand, count(*) FILTER (trim(summary) <> '') AS n_summary, count(*) FILTER (trim(title) <> '') AS n_title FROM {R}",
    "derive_key": f"SELECT trim(product_format) || '_' || trim(review_year::varchar) AS survey_id, count(*) AS n FROM {R} GROUP BY 1",
    "low_info_cols": f"SELECT * FROM ({_stats_sql(['rating', 'product_main_category', 'product_has_description', 'has_image', 'helpful_votes', 'product_price'])}) WHERE missing_share > 0.95 OR n_distinct < 2",
    "thin_columns": f"SELECT \"column\", \"column\" = 'product_format' AS required, missing_share, n_distinct FROM ({_stats_sql(_COLS)}) WHERE \"column\" = 'product_format' OR (missing_share <= 0.85 AND n_distinct > 1) ORDER BY 2 DESC, 3, 4 DESC, 1 LIMIT 12",
    "int_to_cat": f"SELECT rating::bigint::varchar AS rating, has_image::varchar AS has_image, count(*) AS n, sum(helpful_votes)::bigint AS votes FROM {R} GROUP BY 1, 2",
    "numeric_shares": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN try_cast({c} AS double) IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM {R}" for c in ("review_date", "product_format", "brand", "summary")),
    "collapse_rare": f"WITH c AS (SELECT brand, count(*) AS n FROM {R} WHERE brand IS NOT NULL GROUP BY 1), k AS (SELECT brand FROM c WHERE n >= 30 ORDER BY n DESC, brand LIMIT 79), p AS (SELECT coalesce(sum(n), 0) AS p FROM c WHERE brand NOT IN (SELECT brand FROM k)) SELECT CASE WHEN b.brand IS NULL OR b.brand IN (SELECT brand FROM k) OR (SELECT count(*) FROM k) = 0 THEN b.brand WHEN p >= 30 THEN 'Other' END AS brand, count(*) AS n FROM {R} b, p GROUP BY 1",
    "guard_levels": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS levels, count(DISTINCT {c}) <= 80 AS allowed FROM {R}" for c in ("brand", "product_format", "rating")),
    "is_binary": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", bool_and({c} IN (0, 1)) AS binary FROM {R}" for c in ("has_image", "verified_purchase", "rating", "helpful_votes")),
    "prep_spec": f"SELECT count(*) AS n, round(avg(helpful_votes), 6) AS mean_votes, round(avg(product_price), 6) AS mean_price, count(DISTINCT product_format) AS levels, (SELECT count(*) FROM {R}) AS n_before FROM {R} WHERE helpful_votes <> 0 AND product_price IS NOT NULL AND product_format IS NOT NULL",
    "text_norm": "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL",
    "scrub_text": f"SELECT review_id, length({_SCRUB}) AS n, md5({_SCRUB}) AS digest FROM {R} WHERE review_text IS NOT NULL",
    "text_features": f"SELECT doc_id, length(text) AS chars, len({_WORDS}) AS words, greatest(len(regexp_extract_all(text, '[.!?]+(\\s|$)')), 1) AS sentences FROM documents WHERE text IS NOT NULL",
    "lexical": f"SELECT doc_id, round(coalesce(list_sum(list_transform({_WORDS}, lambda w: length(w)))::double / nullif(len({_WORDS}), 0), 0), 2) AS mean_length, round(coalesce(len(list_distinct(list_transform({_WORDS}, lambda w: lower(w))))::double / nullif(len({_WORDS}), 0), 0), 4) AS unique_ratio FROM documents WHERE text IS NOT NULL",
    "punct": "SELECT doc_id, length(text) - length(replace(text, '!', '')) AS exclamations, length(text) - length(replace(text, '?', '')) AS questions, round(len(regexp_extract_all(text, '[A-Z]'))::double / greatest(len(regexp_extract_all(text, '[A-Za-z]')), 1), 4) AS uppercase, CASE WHEN contains(text, '!') THEN 1 ELSE 0 END AS has_exclamation FROM documents WHERE text IS NOT NULL",
    "parse_num": "SELECT o_orderkey, o_orderkey * 1000 AS n, o_totalprice::decimal(18, 2)::double AS price, o_orderkey * 1000 AS rank FROM orders",
    "json_int_count": "SELECT event_id, len(regexp_extract_all(props, '\\d+')) AS numbers, json_extract_string(props, '$.k') AS k FROM events",
    "title_features": f"SELECT review_id, length(title) - length(replace(title, ' ', '')) + 1 AS title_words, CASE WHEN title LIKE '%?%' THEN 1 ELSE 0 END AS has_question, CASE WHEN title LIKE '%:%' THEN 1 ELSE 0 END AS has_colon FROM {R} WHERE title IS NOT NULL",
    "log_features": f"SELECT review_id, round(ln(coalesce(helpful_votes, 0) + 1), 6) AS log_votes, greatest(coalesce(product_also_buy_count, 0), coalesce(product_also_view_count, 0)) AS also FROM {R}",
    "decade": f"SELECT (review_year // 10 * 10)::int AS decade, count(*) AS n FROM {R} GROUP BY 1",
    "slug": f"SELECT regexp_replace(regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n FROM {R} WHERE brand IS NOT NULL GROUP BY 1",
    "epoch_dates": f"SELECT year(make_timestamp(review_unix * 1000000)) AS year, strftime(make_timestamp(review_unix * 1000000), '%Y-%m-%d') AS day, count(*) AS n FROM {R} WHERE review_unix IS NOT NULL GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (clean_inf, missingness, recode_missing, neg_to_null, blank_null, derive_key, low_info_cols, thin_columns, int_to_cat, numeric_shares, collapse_rare, guard_levels, is_binary, prep_spec, text_norm, scrub_text, text_features, lexical, punct, parse_num, json_int_count, title_features, log_features, decade, slug, epoch_dates)}
