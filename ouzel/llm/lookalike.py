"""One form for texts that look alike, computed by DuckDB inside Arrow partitions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .words import refuse_clash

# Characters that a reader doesn't see.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\uffa0"
# Blanks of any width.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Letters and signs of other scripts, and below each the sign it looks like.
ALIKE = (
    ("АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝӏЁёЇї", "ABEKMHOPCTYXSIJQWaeopcyxsijhdqwlËëÏï"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"),
    ("\u212a\u212b\u2010\u2011", "K\u00c5--"),
    ("ѴѵҮӀӔӕ", "VvYlÆæ"),
    ("αγικνρυχϲϳͿϹ", "ayikvpuxcjJC"),
    ("ՏՍՕԼօսհոցյզ", "SUOLouhngjq"),
    ("ɑɡ", "ag"),
)
# Ways of decomposition (as Unicode calls them) that keep a character's look.
SAME_LOOK = ("<font>", "<wide>", "<narrow>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")
# Characters with such a decomposition that look otherwise.
OTHER_LOOK = "\u017f\u2024"


@cache
def compatibility() -> dict[str, str]:
    """Letters, numbers and points that Unicode calls compatibility forms of others of the same look: their plain forms.

    Full-width ASCII and blanks have mappings of their own. Raised, lowered and circled signs look otherwise and stay.
    """
    out = {}
    for i in range(0xA0, min(0x30000, sys.maxunicode)):
        c = chr(i)
        way = unicodedata.decomposition(c)
        if way.startswith(SAME_LOOK) and c not in OTHER_LOOK and unicodedata.category(c)[0] in "LNP" and not 0xFF01 <= i < 0xFF5F:
            plain = unicodedata.normalize("NFKC", c)
            if plain.isascii() or not plain.startswith(" "):
                out[c] = plain
    return out


def _class(characters: str) -> str:
    """A regular expression's class of characters, as ranges."""
    codes = sorted(map(ord, characters))
    runs: list[list[int]] = []
    for x in codes:
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The DuckDB expression of the consistent form of ``column``.

    Invisible characters go; compatibility forms of the same look (full-width and half-width forms, blanks, ligatures,
    mathematical letters, Roman numerals, dots in one sign) become plain; accents are composed;
    look-alike letters become Latin throughout, in words of any script, so that equal looks give equal
    forms. Case, accents, digits, line breaks and the number of blanks stay. Null stays null.

    Forms are mapped only in texts that have any, as ``translate`` reads its tables anew for each text.
    """
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    forms = compatibility()
    one = {c: p for c, p in forms.items() if len(p) == 1}
    many = {c: p for c, p in forms.items() if len(p) > 1 and (p.isascii() or re.fullmatch(r"[\w]{2,3}", p) and ord(c) < 0x600)}
    x = f"regexp_replace({column}, '[{INVISIBLE}]', '', 'g')"
    x = f"translate({x}, {_quoted(wide + BLANKS)}, {_quoted(plain + ' ' * len(BLANKS))})"
    longer = "_x"
    for c, p in many.items():
        longer = f"replace({longer}, {_quoted(c)}, {_quoted(p)})"
    longer = f"translate({longer}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    x = f"list_transform([{x}], lambda _x: CASE WHEN regexp_matches(_x, '{_class(''.join([*one, *many]))}') THEN {longer} ELSE _x END)[1]"
    x = f"nfc_normalize({x})"
    x = f"translate({x}, {_quoted(''.join(a for a, _ in ALIKE))}, {_quoted(''.join(b for _, b in ALIKE))})"
    return f"nfc_normalize({x})"


def in_duckdb(batches: Iterator[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """Run ``sql`` over each Arrow batch, which it knows as ``batch``."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches()
            con.unregister("batch")


def consistent_form(df: DataFrame, text: str, keep: list[str], name: str = "form") -> DataFrame:
    """The ``keep`` columns and ``name``, the consistent form of ``text`` (see ``form_sql``).

    Null gives null, empty gives empty, texts are taken whole, repeated rows stay. Columns not kept are
    left out, whatever their names.
    """
    refuse_clash(keep, (name, "_text"))
    src = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` string"])
    cols = "".join(f'"{c}", ' for c in keep)
    sql = f'SELECT {cols}{form_sql("_text")} AS "{name}" FROM batch'
    return src.mapInArrow(lambda batches: in_duckdb(batches, sql), schema)


def alike_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Pairs ``(doc_a, doc_b)``, ``doc_a`` < ``doc_b``, that look the same but aren't the same sequence.

    Only digests are shuffled. Each different text counts once until the pairs of texts are known, so
    that masses of equal texts cost nothing. Null texts make no pairs.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("exact"), F.col(text).alias("text"))
    digests = consistent_form(src, "text", ["id", "exact"]).select("id", "exact", F.unhex(F.md5("form")).alias("look"))
    from ..session import stage

    digests = stage(digests, "looks")
    mixed = stage(digests.groupBy("look").agg(F.min("exact").alias("x"), F.max("exact").alias("y")).where("x <> y").select("look"), "mixed")
    rows = stage(digests.join(mixed, "look"), "alike")
    a, b = rows.select("look", F.col("exact").alias("exact_a"), F.col("id").alias("doc_a")), rows.select("look", F.col("exact").alias("exact_b"), F.col("id").alias("doc_b"))
    return a.join(b, "look").where((F.col("doc_a") < F.col("doc_b")) & (F.col("exact_a") != F.col("exact_b"))).select("doc_a", "doc_b")
