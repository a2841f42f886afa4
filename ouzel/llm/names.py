"""Spellings of publishers' and authors' names, linked by metric-space partitioning."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..operators.components import connected_components
from ..session import stage

RADIUS = 2
#: Pivots of a block besides the empty string; by how many a large block is cut; from how many names a block is large.
PIVOTS, RINGED, SMALL = 7, 2, 4096

# Given names and their common short forms.
SHORT_FORMS = {
    "abigail": "abby abbie gail", "alexander": "alex sandy al xander", "andrew": "andy drew", "anthony": "tony",
    "bartholomew": "bart", "benjamin": "ben", "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave", "dorothy": "dot dottie dolly dora", "edward": "ed eddie ned", "elizabeth": "liz beth eliza betty bess",
    "frederick": "fred freddie", "gregory": "greg", "harold": "harry hal", "henry": "hank", "isabella": "bella izzy isa",
    "jacqueline": "jackie", "james": "jim jimmy", "john": "jack johnny", "joseph": "joe", "josephine": "josie jo",
    "katherine": "kate kathy katie kay", "leonard": "len lenny leo", "margaret": "peggy maggie meg", "matilda": "tilly mattie", "michael": "mike",
    "nicholas": "nick nicky", "oliver": "ollie", "patricia": "pat patty", "penelope": "penny", "peter": "pete",
    "rebecca": "becky becca", "richard": "dick rick rich", "robert": "bob rob bobby", "samuel": "sam", "stephen": "steve",
    "susannah": "sue susie sukie", "theodore": "ted theo teddy", "thomas": "tom", "ursula": "ulla", "victoria": "vicky tori",
    "vincent": "vince vinnie", "william": "bill will billy", "zachary": "zach zack",
}
# Words that tell a publisher's kind, and their abbreviations.
KIND_WORDS = {
    "press": "pr", "books": "bks bk book", "publishing": "publ pub", "publishers": "pubs publisher", "company": "co comp",
    "university": "univ", "academic": "acad", "verlag": "vlg", "group": "grp", "house": "hse", "editions": "ed eds edition",
    "sons": "son", "children": "childrens childs", "of": "", "publications": "pubns publication", "media": "", "library": "lib",
}
# Words about the legal form or the way of listing, which name nobody.
EMPTY_WORDS = set("the by inc ltd limited llc plc gmbh corp incorporated and".split())
# What is written where a name is missing.
PLACEHOLDERS = set("na none null unknown various anonymous anon unbranded generic nil tbd other author publisher variousauthors unknownauthor noname notavailable notapplicable unknownpublisher variouspublishers".split())

_SHORT = {s: full for full, shorts in SHORT_FORMS.items() for s in shorts.split()} | {"alex": "alexander"}
_KIND = {a: w for w, abbreviations in KIND_WORDS.items() for a in (w, *abbreviations.split())}
_LEAD = re.compile(r"^\s*(?:see all titles by|visit amazon'?s|by)\s+|\s+page\s*$|\([^)]*\)|\[[^\]]*\]", re.I)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein's distance with a swap of neighbours as one edit; most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(1 << 16)
def _near_kind(w: str) -> str | None:
    return _near_word(w, _KIND)


def _near_word(w: str, vocabulary: dict[str, str], least: int = 5) -> str | None:
    """The vocabulary's word for ``w``: itself or one that is a slip of the pen away."""
    if w in vocabulary:
        return vocabulary[w]
    if len(w) < least:
        return None
    best = None
    for v in vocabulary:
        if len(v) >= least:
            most = 2 if len(v) >= 7 and v[0] in w[:2] else 1
            d = edit_distance(w, v, most)
            if d <= most and (best is None or d < best[0]):
                best = d, vocabulary[v]
    return best and best[1]


_GIVEN = {g: g for g in SHORT_FORMS}


@lru_cache(1 << 16)
def given_name(w: str) -> str:
    """The full form of a given name, of its short forms and of slips of either."""
    if len(w) == 1 or w in SHORT_FORMS:
        return w
    return _SHORT.get(w) or _near_word(w, _GIVEN, 4) or w


def _split_joined(token: str) -> list[str]:
    """Words of a joined spelling such as HouseofName or NamePublishingCompany."""
    parts = re.findall(r"[A-Z][^A-Z]*|^[^A-Z]+", token)
    if len(parts) < 2:
        return [token]
    out: list[str] = []
    for p in parts:
        m = re.fullmatch(r"(House|Hse)of", p)
        out += [m[1], "of"] if m else [p]
    return out


def parse(name: str) -> tuple[str, str, str, str] | None:
    """``(kind, core, given, middle)`` of a name, or None for a placeholder.

    ``kind`` is "" for a person, else the sorted words of the publisher's kind; ``core`` is the surname or
    the publisher's own name, in plain small letters without blanks.
    """
    x = _LEAD.sub(" ", unicodedata.normalize("NFKC", name))
    x = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))
    if re.sub(r"[\W_]+", "", x).lower() in PLACEHOLDERS or not re.search(r"[^\W\d_]", x):
        return None
    x = re.sub(r"['’]", "", x.replace("+", "&")).strip()
    x = re.sub(r"([A-Z])-([a-z])", r"-\1\2", x)  # a swapped hyphen
    x = re.sub(r"(\w),(\w)\s", r"\1\2, ", x)  # a swapped comma
    x = re.sub(r"^.*\S.*\sby\s+", "", x, flags=re.I)  # a damaged way of listing
    x = re.sub(r"\bUP\b", "University Press", x)
    if " " not in x.strip() and "-" in x:
        x = x.replace("-", " ")
    if " " not in x.strip() or re.search(r"[a-z][A-Z]", x):
        x = " ".join(p for t in x.split() for p in (_split_joined(t) if not t.isupper() else [t]))
    comma = "," in x
    front, _, back = x.partition(",")
    words = [w for w in re.findall(r"[^\W_]+|&", x.lower())]
    plain = [w for w in words if w not in EMPTY_WORDS and w != "&" and (len(w) < 6 or edit_distance(w, "limited", 1) > 1)]
    if not plain:
        return None
    kinds: dict[int, str] = {}
    for i, w in enumerate(plain):
        k = _near_kind(w)
        if k and not (len(w) == 2 and w == "ed" and i == len(plain) - 1 and len(plain) == 2 and comma):
            kinds[i] = k
    core = [w for i, w in enumerate(plain) if i not in kinds]
    real = [k for k in kinds.values() if k != "of"]
    if real and core:
        return " ".join(sorted(set(kinds.values()))), "".join(core), "", ""
    if real:  # all words tell a kind; the longest is the name
        i = max(kinds, key=lambda i: len(plain[i]))
        return " ".join(sorted({k for j, k in kinds.items() if j != i})) or "house", plain[i], "", ""
    if comma:
        surname = [w for w in re.findall(r"[^\W_]+", front.lower()) if w not in EMPTY_WORDS]
        given = [w for w in re.findall(r"[^\W_]+", back.lower()) if w not in EMPTY_WORDS]
    elif len(plain) > 1 and len(plain[-1]) == 1:  # Surname I.
        surname, given = plain[:1], plain[1:]
    else:
        surname, given = plain[-1:], plain[:-1]
    if not surname:
        return None
    if not given:
        return "?", "".join(surname), "", ""
    middle = given[1][0] if len(given) > 1 else ""
    return "", "".join(surname), given_name(given[0]), middle


def _parse_stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parsed = [(n, *p) for n in b["name"] if (p := parse(n))]
        yield pd.DataFrame(parsed, columns=["name", "kind", "core", "given", "middle"])


def radius_pairs(points: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """All pairs ``(block, x, y)``, x < y, of different ``core`` of one ``block`` within ``radius`` edits.

    The metric is Levenshtein's, with blocks infinitely far apart. Each block has up to ``PIVOTS`` pivots, the first by
    hash, and the empty string, whose distance is the length. By the triangle inequality, two names within the radius
    differ in no distance to a pivot by more than it. A block of more than ``small`` names is cut into cells by its
    names' distances to the first ``RINGED`` pivots, in rings of 2 * radius + 1. A name lives in one cell. It is copied to the
    next outer ring if it lies within the radius of it; so a pair meets in the outer one of both names' rings of each
    pivot, and only there may it be found, as in any other cell they meet in both are copies. A name has
    about 1.4 ** ``RINGED`` places. Within a cell, which a task holds, distances to all pivots are compared before the edit distance is computed.
    """
    pts = stage(points.select("block", "core").distinct(), "points")
    h = F.xxhash64("core")
    size = pts.groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct(h, "core")).alias("least"))
    chosen = (F.pmod(h, F.lit(1_000_000_000)) < 3e9 * PIVOTS / F.col("n")) | (F.col("core") == F.col("least.core"))
    # Some three times as many as needed are gathered for each block, in any number of names.
    centres = _beside(pts, size).where(chosen).groupBy("block", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct(h.alias("h"), "core"))), 1, PIVOTS).alias("p"))
    centres = stage(centres, "pivots")
    distance = [F.length("core"), *(F.coalesce(F.levenshtein("core", F.get(F.col("p"), i)["core"]), F.lit(0)) for i in range(PIVOTS))]
    far = _beside(pts, centres).select("block", "core", "n", *(d.cast("short").alias(f"d{i}") for i, d in enumerate(distance)))
    ring = 2 * radius + 1
    cells = F.when(F.col("n") > small, F.array(*(F.floor(F.col(f"d{i}") / ring).cast("int") for i in range(RINGED)))).otherwise(F.array(*[F.lit(0)] * RINGED))
    near = F.array(*(((F.col("n") > small) & (F.col(f"d{i}") % ring >= ring - radius)).cast("int") for i in range(RINGED)))
    placed = far.withColumn("cells", cells).withColumn("near", near).withColumn("copy", F.explode(F.array(*map(F.lit, range(1 << RINGED)))))
    bit = lambda i: F.shiftright("copy", i).bitwiseAND(F.lit(1))
    placed = placed.where(F.col("copy").bitwiseAND(sum((F.shiftleft(F.get("near", i), i) for i in range(RINGED)), F.lit(0))) == F.col("copy"))
    placed = placed.select("block", "core", F.concat_ws(",", *(F.get("cells", i) + bit(i) for i in range(RINGED))).alias("cell"), "copy", *(f"d{i}" for i in range(PIVOTS + 1)))
    placed = stage(placed, "cells")
    # Cells are small in bytes and dear to compare: a number of partitions is asked for, so that they aren't put together.
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.repartition(tasks, "block", "cell").sortWithinPartitions("block", "cell")
    close = rows.mapInPandas(_cell_stage(radius), "block string, x string, y string")
    return close.where(F.levenshtein("x", "y", radius).between(1, radius)).select("block", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _cell_stage(radius: int):
    """Pairs within each cell whose distances to all pivots allow the radius, each in one cell only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in itertools.chain(batches, [None]):
            if b is not None and len(b):
                held.append(b)
                first, last = held[0].iloc[0], b.iloc[-1]
                if first["block"] == last["block"] and first["cell"] == last["cell"]:
                    continue
            if not held or b is not None and not len(b):
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows.iloc[-1]
            open_ = ((rows["block"] == last["block"]) & (rows["cell"] == last["cell"])).to_numpy() & (b is not None)  # the last cell may go on
            for (block, _), cell in rows[~open_].groupby(["block", "cell"], sort=False):
                yield from _within_cell(block, cell, radius)
            held = [rows[open_]] if open_.any() else []

    return run


def _within_cell(block: str, cell: pd.DataFrame, radius: int, most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    cell = cell.sort_values("d0")
    names, copy = cell["core"].to_numpy(object), cell["copy"].to_numpy()
    d = [cell[f"d{i}"].to_numpy(np.int16) for i in range(PIVOTS + 1)]
    start = 0
    while start < len(cell) - 1:
        until = start + 1
        reach = int(np.searchsorted(d[0], d[0][start] + radius, "right"))
        while until < len(cell) and (until + 1 - start) * (reach - start) <= most:
            reach = int(np.searchsorted(d[0], d[0][until] + radius, "right"))
            until += 1
        here, there = np.arange(start, until), np.arange(start, reach)
        ok = (here[:, None] < there) & (copy[here][:, None] & copy[there] == 0)
        for v in d[:3]:
            ok &= np.abs(v[here][:, None] - v[there]) <= radius
        i, j = np.nonzero(ok)
        for v in d[3:]:
            like = np.abs(v[here[i]] - v[there[j]]) <= radius
            i, j = i[like], j[like]
        if len(i):
            yield pd.DataFrame({"block": block, "x": names[here[i]], "y": names[there[j]]})
        start = until


def _beside(points: DataFrame, blocks: DataFrame, salts: int = 64) -> DataFrame:
    """``points`` with the columns of ``blocks``, which has a row for each block; no large block gathers in one task."""
    salt = F.pmod(F.xxhash64("core"), F.lit(salts))
    spread = blocks.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return points.withColumn("salt", salt.cast("int")).join(spread, ["block", "salt"]).drop("salt")


def entities(names: DataFrame, column: str, radius: int = RADIUS) -> DataFrame:
    """``name, entity``: each different stored spelling in ``column`` and its publisher's or author's id.

    Publishers of the same kind ("press", "books") are one if their own names are within ``radius`` edits;
    authors if surname and full given name together are, and their middle initials don't contradict. An
    initial alone joins the only author with such a surname; if there are several, it stays by itself.
    Null, blank and placeholder names give no rows; letter case, accents, blanks, punctuation, legal forms,
    roles, order of parts and usual abbreviations don't count. Repeated rows and other columns don't
    matter. Ids are stable for the same names.
    """
    raw = names.select(F.col(column).cast("string").alias("name")).where("trim(name) <> ''").distinct()
    parsed = stage(raw.mapInPandas(_parse_stage, "name string, kind string, core string, given string, middle string"), "names")
    initial = (F.length("given") == 1)
    keys = parsed.select("kind", "core", "given").distinct().withColumn("key", F.concat_ws("|", "kind", "given", "core"))
    block = F.when(F.col("kind") == "", F.concat(F.lit("person "), F.left("given", F.lit(1)))).otherwise(F.col("kind"))
    keys = stage(keys.withColumn("block", block), "keys")
    pairs = stage(radius_pairs(keys, radius), "near")
    both = pairs.unionAll(pairs.select("block", F.col("y").alias("x"), F.col("x").alias("y")))
    same = keys.select("block", F.col("core").alias("x"), F.col("core").alias("y")).distinct()
    reach = both.unionAll(same)
    full = keys.where(~initial)
    l, r = (full.select("block", "kind", F.col("core").alias(c), F.col("given").alias(f"g{c}"), F.col("key").alias(f"k{c}")) for c in "xy")
    linked = reach.join(l, ["block", "x"]).join(r.drop("kind"), ["block", "y"]).where("kx < ky")
    budget = F.levenshtein("x", "y") + F.levenshtein("gx", "gy")
    slip = F.levenshtein("gx", "gy") <= F.when(F.least(F.length("gx"), F.length("gy")) >= 5, radius).otherwise(F.lit(0))
    links = linked.where((budget <= radius) & slip).select(F.col("kx").alias("src"), F.col("ky").alias("dst"))
    own = full.select(F.col("key").alias("src"), F.col("key").alias("dst"))
    groups = stage(connected_components(links.unionAll(own)).withColumnRenamed("node", "key"), "groups")
    placed = full.join(groups, "key")
    first = keys.where(initial).select("block", F.col("core").alias("x"), F.col("key").alias("kx"))
    options = first.join(reach, ["block", "x"]).join(placed.select("block", F.col("core").alias("y"), "component"), ["block", "y"])
    options = options.withColumn("d", F.levenshtein("x", "y"))
    nearest = options.withColumn("least", F.min("d").over(Window.partitionBy("kx"))).where("d = least")
    sole = nearest.groupBy("kx").agg(F.count_distinct("component").alias("n"), F.min("component").alias("component")).where("n = 1")
    alone = keys.where(initial).select("key").join(sole, F.col("key") == F.col("kx"), "left").select("key", F.coalesce("component", "key").alias("component"))
    where = placed.select("key", "component").unionAll(alone)
    found = parsed.withColumn("key", F.concat_ws("|", "kind", "given", "core")).join(where, "key")
    # Namesakes with different middle initials: those without one go with the only initial there is.
    inits = found.where("middle <> ''").groupBy("component").agg(F.count_distinct("middle").alias("n"))
    split = found.join(inits, "component", "left")
    entity = F.when(F.coalesce("n", F.lit(0)) > 1, F.concat_ws("|", "component", "middle")).otherwise(F.col("component"))
    return split.select("name", entity.alias("entity"))


def same_name_pairs(names: DataFrame, column: str, radius: int = RADIUS) -> DataFrame:
    """``(name_a, name_b)``: different spellings of one entity, the first less by code points."""
    e = stage(entities(names, column, radius), "entities")
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
