"""Text features as columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def scrub(c: Column) -> Column:
    """Control characters as blanks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentence_count(c: Column) -> Column:
    return F.greatest(F.regexp_count(c, F.lit(r"[.!?]+(\s|$)")), F.lit(1))


def mean_word_length(c: Column) -> Column:
    n = F.aggregate(words(c), F.lit(0), lambda a, w: a + F.length(w))
    return F.round(F.coalesce(F.try_divide(n.cast("double"), word_count(c)), F.lit(0.0)), 2)


def unique_word_ratio(c: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.size(F.array_distinct(words(F.lower(c)))).cast("double"), word_count(c)), F.lit(0.0)), 4)


def sign_count(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def uppercase_ratio(c: Column) -> Column:
    """Of plain letters; 0 where there are none."""
    upper, alpha = F.regexp_count(c, F.lit("[A-Z]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.round(upper / F.greatest(alpha, F.lit(1)), 4)


def parse_count(c: Column) -> Column:
    """ "1,234" as 1234; null if it is no number."""
    return F.expr("try_cast(x as bigint)") if c is None else F.regexp_replace(c, ",", "").try_cast("bigint")


def parse_price(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")


def parse_rank(c: Column) -> Column:
    """The first number of a rank such as "#1,234 in Books"."""
    return F.regexp_replace(F.regexp_extract(c, r"([\d,]+)", 1), ",", "").try_cast("bigint")


def json_number_count(c: Column) -> Column:
    """Runs of digits in a JSON text."""
    return F.regexp_count(c, F.lit(r"\d+"))


def title_features(c: Column) -> dict[str, Column]:
    return {"title_words": sign_count(c, " ") + 1, "has_question": F.contains(c, F.lit("?")).cast("int"), "has_colon": F.contains(c, F.lit(":")).cast("int")}


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def dsl_head(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(c), r"^(\w+)\s*\(", 1))


def dsl_normal(c: Column) -> Column:
    """Lower case, no brackets, single blanks; the two sides of a plain association in order."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\[\]]", ""), r"\s+", " "))
    pattern = r"^assoc\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)(.*)$"
    a, b, rest = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    return F.when(a != "", F.concat(F.lit("assoc("), F.least(a, b), F.lit(", "), F.greatest(a, b), F.lit(")"), rest)).otherwise(t)


def dsl_rank(head: Column) -> Column:
    """Depth of a test: association or difference 1, interaction 2, heterogeneity 3, others 0."""
    return F.when(head.isin("assoc", "diff", "correlation"), 1).when(head.isin("interact", "interaction"), 2).when(head == "heterogeneity", 3).otherwise(0)
