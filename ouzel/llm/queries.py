"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bisection, golay, leak, lookalike, mixing, mojibake, names, quality, topn

REVIEWS = "amazon_books_autokd"
SHARES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def texts_to_compare(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, REVIEWS).select(F.lit("review_text").alias("field"), F.col("review_id").cast("string").alias("id"), F.col("review_text").alias("text"))
    i = table(spark, d, "insight").select(F.lit("sentence").alias("field"), F.col("insight_id").alias("id"), F.col("sentence").alias("text"))
    return r.unionAll(i)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return golay.near_copy_rows(texts_to_compare(spark, d), threshold=0.6, shingle=3, min_words=20)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each text of at least 20 words with its group and number of links, at five words and 0.8."""
    return golay.near_copy_groups(texts_to_compare(spark, d), threshold=0.8, shingle=5, min_words=20)


def fields(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """``field, review_id, text`` of several text columns of the reviews."""
    r = table(spark, d, REVIEWS)
    parts = [r.select(F.lit(n).alias("field"), "review_id", F.col(n).alias("text")) for n in names]
    return parts[0].unionAll(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(fields(spark, d, "title", "review_text"), "text", ["field", "review_id"]).select("field", "review_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(fields(spark, d, "title", "review_text"), "text", ["field", "review_id"])


def review_groups(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, REVIEWS)
    kinds = {"asin": "asin", "format": "product_format", "year": "review_year", "day": "review_date"}
    by = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("grp")) for k, c in kinds.items())))
    what = F.explode(F.array(F.struct(F.lit("rating").alias("metric"), F.col("rating").alias("value")), F.struct(F.lit("helpful_votes").alias("metric"), F.col("helpful_votes").cast("double").alias("value"))))
    return r.select("asin", "product_format", "review_year", "review_date", "rating", "helpful_votes").select(by.alias("b"), "rating", "helpful_votes").select("b.*", what.alias("w")).select("w.metric", "kind", "grp", "w.value")


def citation_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cite_agg").select("paperid", "normalized_citation", "loaded_on")
    f = table(spark, d, "field_agg").select("paperid", "primary_field_name")
    by = F.explode(F.array(F.struct(F.lit("field").alias("kind"), F.col("primary_field_name").alias("grp")), F.struct(F.lit("loaded_on").alias("kind"), F.col("loaded_on").cast("string").alias("grp"))))
    return c.join(f, "paperid", "left").select(by.alias("b"), "normalized_citation").select(F.lit("normalized_citation").alias("metric"), "b.*", F.col("normalized_citation").alias("value"))


KEYS = ["metric", "kind", "grp"]


def p3_review_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return bisection.percentiles(bisection.value_counts(review_groups(spark, d), KEYS, "value"), KEYS, SHARES)


def p3_citation_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return bisection.percentiles(bisection.value_counts(citation_groups(spark, d), KEYS, "value"), KEYS, SHARES)


def p3_combined_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all days from states kept per day of loading (here: per ``loaded_on``), exact for the rounded values.

    ``p3_combined_days_bounds`` states how far they may be from those of the values as they are.
    """
    return bisection.percentiles(_combined_days(spark, d), ["grp"], SHARES)


def p3_combined_days_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same, with half the resolution of the states in the bound of the error."""
    return bisection.percentiles(_combined_days(spark, d), ["grp"], SHARES, resolution=0.01)


def _combined_days(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cite_agg").select(F.col("loaded_on").alias("day"), "normalized_citation").withColumn("grp", F.lit("all days"))
    daily = bisection.value_counts(c, ["day", "grp"], "normalized_citation", resolution=0.01)
    return bisection.combine([daily.drop("day")], ["grp"])


def _percentile_sql(rows: str, keys: str) -> str:
    shares = ", ".join(f"({p}::double)" for p in SHARES)
    return f"""
    WITH r AS ({rows}), c AS (SELECT {keys}, value, count(*) AS n FROM r WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {keys}) AS n_rows FROM c)
    SELECT {keys}, p AS percentile, n_rows::bigint AS n_rows, min(value) AS value, 0::double AS error_bound
    FROM u, (VALUES {shares}) AS s(p) WHERE upto >= greatest(1, ceil(round(p * n_rows, 9))) GROUP BY {keys}, p, n_rows"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(table(spark, d, REVIEWS), "brand").select(F.col("name_a").alias("brand_a"), F.col("name_b").alias("brand_b"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, REVIEWS), "brand")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, REVIEWS).where(F.col("asin").rlike(r"\S"))
    return topn.top_n(r, ["asin"], "helpful_votes", ["review_id"], 3).select("asin", "review_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(fields(spark, d, "review_text", "summary"), "field", "text", ["review_id"]).select("field", "review_id")


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.distances(quality.statistics(fields(spark, d, "review_text", "summary"), "text", ["field", "review_id"]), "field")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leak.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_query"), "query_id", ["query_text", "gold_claim"])
    return found.select("doc_id", F.col("item_id").alias("query_id"))


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold parts of it and of such parts."""
    found = leak.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_query"), "query_id", ["query_text", "gold_claim"])
    return found.groupBy(F.col("item_id").alias("query_id")).agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("windows").alias("n_windows"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, d, "documents"), "text", ["doc_id"])


def _words_sql(c: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace({lookalike.form_sql(c)}, '[\u0300-\u036f]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def _runs_sql(w: str) -> str:
    return f"unnest(list_transform(range(1, len({w}) - 10), lambda i: array_to_string({w}[i:i + 11], ' ')))"


_LEAK_SQL = f"""SELECT doc_id, query_id FROM (SELECT doc_id, {_runs_sql('w')} AS r FROM (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL))
 JOIN (SELECT DISTINCT query_id, r FROM (SELECT query_id, {_runs_sql('w')} AS r FROM (SELECT query_id, {_words_sql('query_text')} AS w FROM eval_query UNION ALL SELECT query_id, {_words_sql('gold_claim')} FROM eval_query))) USING (r)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_restored, p3_review_percentiles, p3_citation_percentiles, p3_combined_days, p3_combined_days_bounds, p5_found, p5_entities, p6_found, p7_found, p7_statistics, p8_found, p8_leaked_items, p9_mixture, p9_shares, p10_found, p10_forms)}

SQL = {
    "p3_review_percentiles": _percentile_sql(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, '{k}' AS kind, {c}::varchar AS grp, {m}::double AS value FROM amazon_books_autokd"
            for m in ("rating", "helpful_votes") for k, c in (("asin", "asin"), ("format", "product_format"), ("year", "review_year"), ("day", "review_date"))
        ),
        "metric, kind, grp",
    ),
    "p3_citation_percentiles": _percentile_sql(
        "SELECT 'normalized_citation' AS metric, 'field' AS kind, primary_field_name AS grp, normalized_citation AS value FROM cite_agg LEFT JOIN field_agg USING (paperid)"
        " UNION ALL SELECT 'normalized_citation', 'loaded_on', loaded_on::varchar, normalized_citation FROM cite_agg",
        "metric, kind, grp",
    ),
    "p1_found": f"""WITH t AS (SELECT 'review_text' AS field, review_id::varchar AS id, review_text AS text FROM amazon_books_autokd UNION ALL SELECT 'sentence', insight_id, sentence FROM insight),
        w AS (SELECT field, id, md5(text) AS m, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t WHERE text IS NOT NULL), d AS (SELECT field, m, list_distinct(list_transform(range(1, len(any_value(w)) - 1), lambda i: any_value(w)[i] || ' ' || any_value(w)[i + 1] || ' ' || any_value(w)[i + 2])) AS s FROM w WHERE len(w) >= 20 GROUP BY field, m),
        u AS (SELECT field, m, len(s) AS n, unnest(s) AS s FROM d), p AS (SELECT a.field, a.m AS x, b.m AS y, count(*)::double AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.field = b.field AND a.s = b.s AND a.m < b.m GROUP BY 1, 2, 3),
        q AS (SELECT field, x, y FROM p WHERE c / (na + nb - c) >= 0.6), k AS (SELECT field, id, m FROM w WHERE len(w) >= 20)
        SELECT q.field, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM q JOIN k a ON a.field = q.field AND a.m = q.x JOIN k b ON b.field = q.field AND b.m = q.y UNION ALL SELECT a.field, a.id, b.id FROM k a JOIN k b ON a.field = b.field AND a.m = b.m AND a.id < b.id""",
    "p3_combined_days": _percentile_sql("SELECT 'all days' AS grp, CASE WHEN isinf(normalized_citation) THEN normalized_citation ELSE round(normalized_citation / 0.01) * 0.01 END AS value FROM cite_agg", "grp"),
    "p3_combined_days_bounds": _percentile_sql("SELECT 'all days' AS grp, CASE WHEN isinf(normalized_citation) THEN normalized_citation ELSE round(normalized_citation / 0.01) * 0.01 END AS value FROM cite_agg", "grp").replace("0::double AS error_bound", "CASE WHEN isinf(min(value)) THEN 0 ELSE 0.01 / 2 END::double AS error_bound"),
    "p8_found": f"SELECT DISTINCT doc_id, query_id FROM ({_LEAK_SQL})",
    "p8_leaked_items": f"SELECT query_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_windows FROM ({_LEAK_SQL}) GROUP BY 1",
    "p6_found": "SELECT asin, review_id FROM amazon_books_autokd WHERE regexp_matches(asin, '\\S') AND helpful_votes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asin ORDER BY helpful_votes DESC, review_id) <= 3",
    "p10_found": f"WITH f AS (SELECT doc_id, text, {lookalike.form_sql('text')} AS form FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_forms": f"SELECT doc_id, {lookalike.form_sql('text')} AS form FROM documents",
}
