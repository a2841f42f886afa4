"""Readers and writers."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import text as X

REVIEW = "asin string, reviewerID string, overall double, vote string, verified boolean, image array<string>, style map<string,string>, unixReviewTime bigint, reviewText string, summary string"
PRODUCT = "asin string, title string, brand string, price string, category string, rank string, also_buy array<string>, also_view array<string>, description array<string>, main_cat string"
CARD = "var_name string, module string, label string, question string, options array<struct<code:string,text:string>>, missing_codes map<string,string>"


class MissingColumns(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file with a declared schema; values that don't fit become null."""
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE", escape="\\")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("escape", "\\").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """JSON lines (gzipped ones too) without malformed lines, optionally the first ``rows``."""
    x = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return x if rows is None else x.limit(rows)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(", ".join(missing))
    return df


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.schema(CARD).json(path), ["var_name"])


def write_cards(cards: DataFrame, path: str) -> None:
    cards.write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Insights and raw relations of a graph kept as one JSON document."""
    insight = "struct<id:string,sentence:string,source:string,created_at:string,metadata:map<string,string>>"
    relation = "struct<source_id:string,target_id:string,relation_type:string,linked_at:string>"
    doc = spark.read.schema(f"insights array<{insight}>, relations array<{relation}>").option("multiLine", True).json(path)
    i = doc.select(F.explode("insights").alias("i")).select(F.col("i.id").alias("insight_id"), "i.sentence", "i.source", F.try_to_timestamp("i.created_at").alias("created_at"), "i.metadata")
    r = doc.select(F.explode("relations").alias("r")).select("r.source_id", "r.target_id", "r.relation_type", F.try_to_timestamp("r.linked_at").alias("linked_at"))
    return i, r


def write_graph(insights: DataFrame, relations: DataFrame, place: str) -> None:
    """Both tables as Parquet, one batch per call."""
    insights.write.mode("overwrite").parquet(f"{place}/insights")
    relations.write.mode("overwrite").parquet(f"{place}/relations")


def reviews(raw: DataFrame, scan: bool = True) -> DataFrame:
    """Review records as flat rows with text features. Null texts count as empty, missing votes as 0."""
    text = X.collapse_blanks(X.scrub(F.coalesce("reviewText", F.lit(""))))
    head = X.collapse_blanks(X.scrub(F.coalesce("summary", F.lit(""))))
    when = F.timestamp_seconds("unixReviewTime")
    x = raw.select(
        "asin", F.col("reviewerID").alias("reviewerid"), F.col("overall").alias("rating"), F.coalesce(X.parse_count(F.col("vote")), F.lit(0)).alias("helpful_votes"),
        F.coalesce(F.col("verified").cast("int"), F.lit(0)).alias("verified_purchase"), (F.coalesce(F.size("image"), F.lit(0)) > 0).cast("int").alias("has_image"),
        F.trim(F.element_at("style", "Format:")).alias("product_format"), F.year(when).alias("review_year"), F.date_format(when, "yyyy-MM-dd").alias("review_date"),
        text.alias("review_text"), head.alias("summary"),
    )
    if not scan:
        return x
    t, s = F.col("review_text"), F.col("summary")
    return x.withColumns({
        "review_length": F.length(t), "review_word_count": X.word_count(t), "review_sentence_count": X.sentence_count(t), "review_avg_word_length": X.mean_word_length(t),
        "review_unique_word_ratio": X.unique_word_ratio(t), "review_exclamation_count": X.sign_count(t, "!"), "review_question_count": X.sign_count(t, "?"), "review_uppercase_ratio": X.uppercase_ratio(t),
        "summary_length": F.length(s), "summary_word_count": X.word_count(s), "review_has_exclamation": (X.sign_count(t, "!") > 0).cast("int"), "review_has_question": (X.sign_count(t, "?") > 0).cast("int"),
    })


def products(raw: DataFrame, main_category: str | None = None) -> DataFrame:
    """Product metadata, one row per asin (the first by title). Categories may be nested lists, ranks text or maps."""
    cats = F.expr("filter(split(regexp_replace(category, '[\\\\[\\\\]\"]', ''), '\\\\s*,\\\\s*'), c -> c <> '')")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    x = raw if main_category is None else raw.where(F.col("main_cat") == main_category)
    x = x.select(
        "asin", F.col("title").alias("product_title"), X.collapse_blanks(F.col("brand")).alias("product_brand"), X.parse_price(F.col("price")).alias("product_price"),
        F.try_element_at(cats, F.lit(1)).alias("product_main_category"), F.try_element_at(cats, F.lit(2)).alias("product_sub_category"), X.parse_rank(F.col("rank")).alias("product_sales_rank"),
        size("also_buy").alias("product_also_buy_count"), size("also_view").alias("product_also_view_count"), (size("description") > 0).cast("int").alias("product_has_description"),
    )
    from ..operators.cleaning import keep_first

    return keep_first(x, ["asin"], ["product_title"])


def parse_codebook(text: str) -> list[dict]:
    """Variable cards from a codebook's text: the first card of a variable counts.

    A line "NAME: label" or "NAME label" opens a card (a name of letters and digits that ends with a digit);
    lines "code text", "code. text" or "code - text" with a whole number are its options, negative codes its
    missing ones; a line in capitals opens a module; other lines go on with the question.
    """
    cards: dict[str, dict] = {}
    module, card = "", None
    for raw in text.splitlines():
        line = re.sub(r"\s+", " ", raw).strip()
        if not line:
            continue
        option = re.fullmatch(r"(-?\d+)\s*[.\-–):]?\s+(\S.*)", line)
        head = re.fullmatch(r"([A-Za-z]{1,4}_?\d+[A-Za-z]?)\s*[:.\-–]?\s+(\S.*)", line)
        if head and not option:
            card = {"var_name": head[1], "module": module, "label": head[2], "question": "", "options": [], "missing_codes": {}}
            cards.setdefault(head[1], card)
        elif option and card is not None:
            if option[1].startswith("-"):
                card["missing_codes"][option[1]] = option[2]
            else:
                card["options"].append({"code": option[1], "text": option[2]})
        elif line.isupper() and len(line) > 3:
            module, card = line.title(), None
        elif card is not None:
            card["question"] = f"{card['question']} {line}".strip()
    return list(cards.values())


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """Cards of all codebooks under ``path``; a codebook is one text file."""
    schema = T._parse_datatype_string(f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in re.split(r', (?=[a-z_]+ )', CARD))}>>")
    parse = F.udf(parse_codebook, schema)  # one call per file
    return spark.read.text(path, wholetext=True).select(F.explode(parse("value")).alias("c")).select("c.*")


def infer_scale(options: DataFrame) -> DataFrame:
    """``var_name, n_options, kind`` of cards: binary, ordinal (codes in a row) or nominal; index without options."""
    code = F.transform("options", lambda o: o["code"].try_cast("int"))
    x = options.select("var_name", F.array_compact(F.coalesce(code, F.array().cast("array<int>"))).alias("c"))
    run = (F.array_max("c") - F.array_min("c") + 1) == F.size("c")
    return x.select("var_name", F.size("c").alias("n_options"), F.when(F.size("c") == 0, "index").when(F.size("c") == 2, "binary").when(run, "ordinal").otherwise("nominal").alias("kind"))


class RunLog:
    """A folder of JSON lines and a manifest for one run, on the driver."""

    def __init__(self, place: str, **manifest) -> None:
        self.place = Path(place)
        self.place.mkdir(parents=True, exist_ok=True)
        (self.place / "manifest.json").write_text(json.dumps(manifest, default=str, indent=1))

    def event(self, kind: str, **data) -> None:
        with (self.place / "events.jsonl").open("a") as f:
            f.write(json.dumps({"kind": kind, **data}, default=str) + "\n")

    @staticmethod
    def digest(path: str, size: int = 1 << 20) -> str:
        """SHA-256 of the first megabyte."""
        import hashlib

        with open(path, "rb") as f:
            return hashlib.sha256(f.read(size)).hexdigest()
