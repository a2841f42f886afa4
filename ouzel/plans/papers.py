"""One flat feature row per paper from a star of bibliographic tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.text import decade, json_number_count, title_features
from ..operators.levels import stratified_take

FLAGS = ("is_open", "has_fulltext")


def target_papers(papers: DataFrame, fields: DataFrame, paper_fields: DataFrame, share: float = 1.0, years: tuple[int, int] = (1950, 2024), level_field: str | None = None, seed: int = 0) -> DataFrame:
    """``paperid, year, main_field``: papers of the years with their best top-level field, sampled by field.

    Of equal scores the least field id counts. With ``level_field`` only papers that have it stay. The sample
    takes the same share of each field by a hash of the paper's id.
    """
    top = paper_fields.join(F.broadcast(fields.where("level = 0").select("fieldid", "display_name")), "fieldid")
    best = top.groupBy("paperid").agg(F.max_by("display_name", F.struct("score_openalex", -F.col("fieldid"))).alias("main_field"))
    x = papers.where(F.col("year").between(*years)).select("paperid", "year").join(best, "paperid", "left")
    if level_field is not None:
        x = x.join(top.where(F.col("display_name") == level_field).select("paperid"), "paperid", "left_semi")
    return x if share >= 1 else stratified_take(x, "main_field", "paperid", share, seed)


def field_features(t: DataFrame, fields: DataFrame, paper_fields: DataFrame) -> DataFrame:
    pf = paper_fields.join(t.select("paperid"), "paperid", "left_semi").join(F.broadcast(fields.select("fieldid", "level")), "fieldid", "left")
    top = F.col("level") == 0
    return pf.groupBy("paperid").agg(F.count_distinct("fieldid").alias("num_fields"), F.count_distinct(F.when(top, F.col("fieldid"))).alias("num_level0_fields"), F.max(F.when(top, F.col("score_openalex"))).alias("primary_field_score"))


def _known(c: str) -> Column:
    return F.when(F.trim(c) != "", F.col(c))


def author_features(t: DataFrame, authorships: DataFrame, institutions: DataFrame, authors: DataFrame) -> DataFrame:
    """Team, institutions and countries per paper, and what is known of the first and last author."""
    a = authorships.join(t.select("paperid"), "paperid", "left_semi").join(institutions.select(F.col("institution_id").alias("institutionid"), "country_code", "type"), "institutionid", "left")
    kind = lambda k: F.max(F.when(F.col("type") == k, 1).otherwise(0))
    countries = F.count_distinct(_known("country_code"))
    per = a.groupBy("paperid").agg(
        F.count_distinct("authorid").alias("num_authors"), F.count_distinct(_known("institutionid")).alias("num_institutions"), countries.alias("num_countries"), (countries > 1).cast("int").alias("is_international"),
        F.min(_known("country_code")).alias("primary_country"), kind("company").alias("has_industry"), kind("healthcare").alias("has_healthcare"), kind("government").alias("has_government"),
        F.max(F.when(F.col("author_position") == "first", F.col("authorid"))).alias("first_author"), F.max(F.when(F.col("author_position") == "last", F.col("authorid"))).alias("last_author"),
    )
    for role in ("first", "last"):
        facts = authors.select(F.col("authorid").alias(f"{role}_author"), *(F.col(c).alias(f"{role}_{c}") for c in ("h_index", "productivity", "avg_c10")))
        per = per.join(facts, f"{role}_author", "left")
    return per.drop("first_author", "last_author")


def impact_features(t: DataFrame, normalized: DataFrame, hits: DataFrame) -> DataFrame:
    """Greatest normalised citation and hit flags over a paper's fields; each side is reduced before the join."""
    n = normalized.join(t.select("paperid"), "paperid", "left_semi").groupBy("paperid").agg(F.max("normalized_citations").alias("normalized_citation"))
    h = hits.join(t.select("paperid"), "paperid", "left_semi").groupBy("paperid").agg(*(F.max(c).alias(f"is_{c.lower()}") for c in ("Hit_1pct", "Hit_5pct", "Hit_10pct")))
    return n.join(h, "paperid", "full")


def source_features(t: DataFrame, paper_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """Open access of a paper, one row per paper however many sources it has."""
    s = paper_sources.join(t.select("paperid"), "paperid", "left_semi").join(F.broadcast(sources.select("sourceid", F.col("is_oa").alias("source_oa"))), "sourceid", "left")
    return s.groupBy("paperid").agg(F.max(F.col("is_oa").cast("int")).alias("is_oa"), F.max(F.col("source_oa").cast("int")).alias("in_oa_source"), F.max(F.col("license").isNotNull().cast("int")).alias("has_license"))


def reference_ages(t: DataFrame, references: DataFrame) -> DataFrame:
    r = references.withColumnRenamed("citing_paperid", "paperid").join(t.select("paperid"), "paperid", "left_semi").where("year_diff >= 0")
    age = F.col("year_diff")
    return r.groupBy("paperid").agg(
        F.avg(age).alias("ref_age_mean"), F.median(age).alias("ref_age_median"), F.stddev_samp(age).alias("ref_age_std"), (F.max(age) - F.min(age)).alias("ref_age_span"),
        F.try_divide(F.sum(F.when(age <= 5, 1.0).otherwise(0.0)), F.count(age)).alias("share_recent_refs"),
    )


def text_features(t: DataFrame, texts: DataFrame) -> DataFrame:
    """Lengths from a title and an inverted index; of several texts of one paper the first by title."""
    x = texts.join(t.select("paperid"), "paperid", "left_semi").groupBy("paperid").agg(F.min(F.struct("title", "abstract_inverted_index", "language")).alias("x")).select("paperid", "x.*")
    title = title_features(F.col("title"))
    return x.select("paperid", json_number_count(F.col("abstract_inverted_index")).alias("abstract_words"), F.length("title").alias("title_length"), *(c.alias(k) for k, c in title.items()), (F.col("language") == "en").cast("int").alias("is_english"))


def assemble(tables: dict[str, DataFrame], share: float = 1.0, years: tuple[int, int] = (1950, 2024), level_field: str | None = None, seed: int = 0) -> DataFrame:
    """All features of the target papers. Missing counts are 0; log features use log1p.

    ``tables``: papers, fields, paper_fields, authorships, institutions, authors, normalized, hits,
    paper_sources, sources, laureates, medical, references and, optionally, texts.
    """
    g = tables
    t = target_papers(g["papers"], g["fields"], g["paper_fields"], share, years, level_field, seed)
    x = t.join(g["papers"].drop("year"), "paperid")
    sides = [
        field_features(t, g["fields"], g["paper_fields"]), author_features(t, g["authorships"], g["institutions"], g["authors"]), impact_features(t, g["normalized"], g["hits"]),
        source_features(t, g["paper_sources"], g["sources"]), reference_ages(t, g["references"]),
        g["laureates"].select("paperid").distinct().withColumn("has_laureate", F.lit(1)), g["medical"].select("paperid").distinct().withColumn("is_medical", F.lit(1)),
    ]
    if "texts" in g:
        sides.append(text_features(t, g["texts"]))
    for s in sides:
        x = x.join(s, "paperid", "left")
    zeros = [c for c in ("num_fields", "num_level0_fields", "num_authors", "num_institutions", "num_countries", "is_international", "has_industry", "has_healthcare", "has_government", "is_hit_1pct", "is_hit_5pct", "is_hit_10pct", "is_oa", "in_oa_source", "has_license", "has_laureate", "is_medical") if c in x.columns]
    x = x.fillna(0, zeros)
    for c in ("citation_count", "reference_count", "patent_count", "newsfeed_count"):
        if c in x.columns:
            x = x.withColumn(f"log_{c}", F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.lit(0.0))))
    return x.withColumn("decade", decade(F.col("year")))


def report(features: DataFrame) -> DataFrame:
    """``name, value``: rows, span of years and missing rates above one percent."""
    from ..operators.cleaning import missing_rates

    one = features.agg(F.count("*").cast("double").alias("rows"), F.min("year").cast("double").alias("first_year"), F.max("year").cast("double").alias("last_year"))
    rates = missing_rates(features, [c for c in features.columns if c != "paperid"], 0.01)
    return one.unpivot([], one.columns, "name", "value").unionAll(rates.select(F.concat(F.lit("missing_"), "column"), "missing_rate"))
