"""Text quality statistics and what isn't prose, by robust Mahalanobis distance.

Statistics are computed with numpy over the code points of whole Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..session import stage
from .words import pieces, refuse_clash

# Common words of each language.
COMMON = {
    "en": "the and of to a in is was it for with that this on as but my me i not by be are has have had at from so than what who when where more she he her his its an or if no one out up can will would after before which into over very just all",
    "es": "el la los las de y en un una que es se por con para del al lo su como pero más no me mi sin sobre fue muy ya cuando",
    "fr": "le la les des et en un une que est se par avec pour du au aux ce cette mais plus ne pas je mon ma sans sur dans qui il elle son sa très",
    "de": "der die das und ist in zu den dem ein eine einen mit von für auf als nicht auch sich aber ich mein so wie bei aus nach es war sehr an im",
    "ru": "и в не на что с а но как он она это по из за от мой моя для так же у к очень до когда где был была все",
}
LANGS = tuple(COMMON)
#: The statistics, in order.
STATS = ("log_words", "word_length", "letter_share", "digit_share", "symbol_share", "markup_share", "odd_share", "item_share", "separator_share", "common_share", "unclosed_share", "surprise")
#: The least standard deviation of each: what readers still take for prose, whatever a corpus has.
FLOORS = np.array([1.2, 2.5, 0.12, 0.08, 0.04, 0.08, 0.08, 0.12, 0.1, 0.12, 0.6, 0.5])
#: Which side of the mean counts: +1 above, -1 below, 0 none (the statistic is reported only).
SIDES = np.array([0, 1, -1, 1, 1, 1, 1, 1, 1, -1, 1, 1])
#: Squared distance from which a text is no prose.
CUTOFF = 14.0

_ITEM = re.compile(r"^[^\S\n]*(?:(?:[-*•→·▪+>]|\d{1,3}[^\S\n]?[.):\-]|\(?[a-z\d]\))[^\S\n].*|.*\t.*|.*\|.*\|.*|.*[.·_]{4,}[^\S\n]*\d+[^\S\n]*|[^\s=]{1,60}=\S{1,80};?)$", re.M)
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&#?\w{1,10};|\{\{[^{}\n]{0,80}\}\}|%%\w{1,60}%%|https?://\S+")
_MAY_MARKUP = re.compile(r"[<&{%]|://")
_MAY_ITEM = re.compile(r"[\n\t|=]|\.{4}|^\s*[-*•→·▪+>\d(]")
_NEUTRAL = ".,;:!?'\"()-"
_CLOSING = ".!?…:;,)\"'”’»“*"
_SEPARATORS = ",;/|#\t"
_POWERS = np.uint64(0x9E3779B97F4A7C15) ** np.arange(64, dtype=np.uint64)


class _Tables:
    """Classes of the code points below 0x10000; all above count as letters of no alphabet."""

    def __init__(self) -> None:
        n = 0x10000
        chars = [chr(i) for i in range(n)]
        cat = [unicodedata.category(c)[0] for c in chars]
        full = [unicodedata.category(c) for c in chars]
        self.space = np.array([c.isspace() for c in chars])
        self.letter = np.array([c in "LM" for c in cat])
        self.digit = np.array([c == "Nd" for c in full])
        self.word = self.letter | self.digit
        code = np.arange(n)
        ascii_sign = (code > 32) & (code < 127) & ~self.word
        self.symbol = ascii_sign & ~np.isin(code, [ord(c) for c in _NEUTRAL]) | np.isin(code, [ord(c) for c in "★☆→•"])
        self.foreign = (code >= 128) & ~self.space & ~self.symbol
        self.closing = np.isin(code, [ord(c) for c in _CLOSING])
        self.separator = np.isin(code, [ord(c) for c in _SEPARATORS])
        self.join = np.isin(code, [ord(c) for c in "_=%{}"])
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
        self.small = (code >= 97) & (code <= 122)
        self.large = (code >= 65) & (code <= 90)
        self.hash = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        self.hash ^= self.hash >> np.uint64(31)
        self.hash *= np.uint64(0x94D049BB133111EB)
        word_hash = lambda w: int(sum(int(self.hash[ord(c)]) * int(_POWERS[i]) for i, c in enumerate(w)) & 0xFFFFFFFFFFFFFFFF)
        self.of_lang = [np.sort(np.array([word_hash(w) for w in COMMON[g].split()], np.uint64)) for g in LANGS]
        self.common = np.unique(np.concatenate(self.of_lang))


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed (those above 0xFFFF as a private one)."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes > 0xFFFF, np.uint32(0xE000), codes), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def _within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place: the two letters before and the letter as one number (27 to a place, 0 where a word's
    start or another sign is); whether it is a plain letter."""
    low = tables().lower[codes]
    letter = np.where((low >= 97) & (low <= 122), low - 96, 0).astype(np.int64)
    one = np.concatenate([[0], letter[:-1]])
    two = np.where(one > 0, np.concatenate([[0, 0], letter[:-2]])[: len(letter)], 0)
    return two * 729 + one * 27 + letter, letter > 0


def letter_counts(df: DataFrame, text: str) -> np.ndarray:
    """Counts of plain letters by the two before them over all texts, 27 x 27 x 27."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(27**3, np.int64)
        for b in pieces(batches, "t"):
            triple, letter = _triples(_codes(b["t"].tolist())[0])
            total += np.bincount(triple[letter], minlength=27**3)
        k = np.nonzero(total)[0]
        yield pd.DataFrame({"k": k, "n": total[k]})

    rows = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3)  # so many at most are collected
    out[rows["k"]] = rows["n"]
    return out.reshape(27, 27, 27)


def surprises(n: np.ndarray) -> tuple[np.ndarray, float]:
    """-log2 P(letter | two letters before), smoothed by shorter contexts, and its mean over the counts."""
    one = n.sum((0, 1)) + 0.5
    two = n.sum(0) + 10 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = n + 5 * two
    bits = -np.log2(three / three.sum(2, keepdims=True))
    return bits, float((n * bits).sum() / max(n.sum(), 1))


def text_statistics(texts: list[str], surprise: np.ndarray, usual: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Statistics (a row per text), words, lines and languages of non-blank texts."""
    t = tables()
    codes, sizes = _codes(texts)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    solid = np.maximum(count(~t.space[codes]), 1)
    word = t.word[codes]
    word_start = word & ~np.concatenate([[False], word[:-1]])
    words = count(word_start)
    digits, symbols = count(t.digit[codes]), count(t.symbol[codes])
    letters = count((t.letter | t.foreign)[codes])
    # words by hash, to know the common ones
    at = np.nonzero(word_start)[0]
    owner = np.repeat(np.arange(len(texts)), sizes)
    langs = np.zeros((len(texts), len(LANGS)), np.int64)
    common = np.zeros(len(texts), np.int64)
    if len(at):
        inside = np.nonzero(word)[0]
        which = np.cumsum(word_start)[inside] - 1
        place = inside - at[which]
        h = np.add.reduceat(t.hash[t.lower[codes[inside]]] * _POWERS[np.minimum(place, 63)], np.nonzero(place == 0)[0])
        hit = np.nonzero(_within(t.common, h))[0]
        mine = owner[at[hit]]
        common = np.bincount(mine, minlength=len(texts))
        for g, own in enumerate(t.of_lang):
            langs[:, g] = np.bincount(mine[_within(own, h[hit])], minlength=len(texts))
    # tokens between blanks
    solid_at = ~t.space[codes]
    token_start = solid_at & ~np.concatenate([[False], solid_at[:-1]])
    odd = np.zeros(len(texts), np.int64)
    tok = np.nonzero(token_start)[0]
    if len(tok):
        body = np.nonzero(solid_at)[0]
        first = np.nonzero(token_start[body])[0]
        c = codes[body]
        per = lambda mask: np.add.reduceat(mask.astype(np.int64), first)
        rise = np.zeros(len(codes), bool)
        rise[1:] = t.small[codes[:-1]] & t.large[codes[1:]]
        length, alpha, digit = np.diff(np.append(first, len(body))), per(t.small[c] | t.large[c]), per(t.digit[c])
        strange = (per(c >= 128) == 0) & ((alpha > 0) & (digit > 0) & (length > 4) | (per(t.join[c]) > 0) & (length > 3) | (per(rise[body]) >= 2) | (length >= 30))
        odd = np.bincount(owner[tok], weights=length * strange, minlength=len(texts))
    # lines
    feed = codes == 10
    filled = solid_at.astype(np.int64)
    line_no = np.cumsum(feed) - feed
    per_line = np.bincount(line_no, weights=filled)
    last = np.full(len(per_line), -1, np.int64)
    last[line_no[solid_at]] = np.nonzero(solid_at)[0]  # the last one stays
    real = per_line > 0
    line_owner = owner[last[real]]
    lines = np.bincount(line_owner, minlength=len(texts))
    closed = np.bincount(line_owner, weights=t.closing[codes[last[real]]], minlength=len(texts))
    triple, letter = _triples(codes)
    n_letters = count(letter)
    bits = np.add.reduceat(np.where(letter, surprise.ravel()[triple] - usual, 0.0), starts)
    markup, items = np.zeros(len(texts)), np.zeros(len(texts))
    for i, x in enumerate(texts):
        if _MAY_MARKUP.search(x):
            markup[i] = sum(m.end() - m.start() for m in _MARKUP.finditer(x))
        if _MAY_ITEM.search(x):
            items[i] = sum(m.end() - m.start() for m in _ITEM.finditer(x)) / len(x)
    some = np.maximum(words, 1)
    stats = np.column_stack([
        np.log1p(words), count(word) / some, letters / np.maximum(letters + digits + symbols, 1), digits / solid, symbols / solid,
        np.minimum(markup / solid, 1), np.minimum(odd / solid, 1), items, count(t.separator[codes]) / some, common / some,
        1 - closed / np.maximum(lines, 1), usual + bits / (n_letters + 4),
    ])
    stats[letters + digits + symbols == 0, 2] = 1.0
    best = langs.argmax(1)
    return stats, words, lines, [LANGS[g] if langs[i, g] else None for i, g in enumerate(best)]


def statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``words``, ``lines``, ``lang`` and the ``STATS`` of each non-blank ``text``.

    Shares are of characters other than blanks, except ``letter_share`` (of letters, digits and symbols),
    ``item_share`` (of characters, those on lines laid out as items of a list or cells of a table),
    ``separator_share`` and ``common_share`` (separators and common words to a word) and ``unclosed_share``
    (of lines, those that don't end with punctuation). ``odd_share`` counts tokens that mix letters with
    digits or signs as codes do. ``surprise`` is the mean of -log2 P(letter | two letters before), plain
    letters only, under counts of all texts given, drawn to the usual value in texts of few letters. ``lang`` is the language whose common words occur most, or
    null. Null and blank texts give no rows, whole texts are read, repeated rows stay. Signs and letters
    beyond ASCII count as letters, so that prose read with a wrong encoding stays prose.
    """
    refuse_clash(keep, (*STATS, *(f"part_{s}" for s in STATS), "words", "lines", "lang", "distance2", "_t"))
    src = df.select(*keep, F.regexp_replace(F.col(text).cast("string"), "\r\n?", "\n").alias("_t")).where(F.col("_t").rlike(r"\S"))
    surprise, usual = surprises(letter_counts(df, text))
    cols = [f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*cols, "words long", "lines long", "lang string", *(f"{s} double" for s in STATS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches, "_t"):
            stats, words, lines, langs = text_statistics(b.pop("_t").tolist(), surprise, usual)
            yield b.assign(words=words, lines=lines, lang=langs, **dict(zip(STATS, stats.T)))

    return src.mapInPandas(run, schema)


def _precision(cov: np.ndarray) -> np.ndarray:
    scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-9)
    wide = np.maximum(scale, FLOORS)
    shrunk = cov / np.outer(wide, wide)  # a widened statistic keeps its covariance only
    np.fill_diagonal(shrunk, 1.0)
    return np.linalg.inv((0.9 * shrunk + 0.1 * np.eye(len(wide))) * np.outer(wide, wide))


def contributions(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Each statistic's part of the squared distance; deviations count on one side only."""
    z = x - mean
    z = np.where(SIDES > 0, np.maximum(z, 0), np.where(SIDES < 0, np.minimum(z, 0), 0))
    return z * (z @ precision)


def _scores(b: pd.DataFrame, by: str, params: dict) -> np.ndarray:
    x = b[list(STATS)].to_numpy(float)
    out = np.zeros_like(x)
    group = list(zip(b[by].tolist(), [g if isinstance(g, str) else None for g in b["lang"].tolist()]))
    codes, uniques = pd.factorize(pd.Series(group, dtype=object))
    for k, g in enumerate(uniques):
        mine = codes == k
        out[mine] = contributions(x[mine], *params[g if g in params else (g[0], None)])
    return out


def _moments(stats: DataFrame, by: str, params: dict, trim: float) -> dict:
    """Of prose rows in each group, and in all of each field: count, sums, sums of products."""
    k = len(STATS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for b in batches:
            if not len(b):
                continue
            prose = _scores(b, by, params).sum(1) < trim
            b = b[prose]
            for g, part in b.groupby([by, b["lang"].fillna("")], dropna=False):
                x = part[list(STATS)].to_numpy(float)
                n, s, q = acc.get(g, (0, np.zeros(k), np.zeros((k, k))))
                acc[g] = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame([(g[0], g[1], n, s.tolist(), q.ravel().tolist()) for g, (n, s, q) in acc.items()], columns=["g", "lang", "n", "s", "q"])

    kind = stats.schema[by].dataType.simpleString()
    parts = stats.select(by, "lang", *STATS).mapInPandas(run, f"g {kind}, lang string, n long, s array<double>, q array<double>")
    flat = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("q")[i]).alias(f"q{i}") for i in range(k * k)]
    out: dict = {}
    for r in parts.groupBy("g", "lang").agg(F.sum("n").alias("n"), *flat).collect():  # a row per field and language
        s, q = np.array([r[f"s{i}"] for i in range(k)]), np.array([r[f"q{i}"] for i in range(k * k)]).reshape(k, k)
        for key in {(r.g, r.lang or None), (r.g, None)}:
            n0, s0, q0 = out.get(key, (0, 0.0, 0.0))
            out[key] = n0 + r.n, s0 + s, q0 + q
    return out


def distances(stats: DataFrame, by: str, rounds: int = 3, trim: float = CUTOFF) -> DataFrame:
    """``stats`` with ``distance2`` and ``part_<statistic>``, each statistic's part of it.

    For every value of ``by`` (such as the field) and language, mean and covariance of prose are found from
    all rows in rounds: the first uses medians and fixed spreads (``FLOORS``); rows farther off than ``trim``
    are left out; the rest give the next mean and covariance. A text of no known language, and languages
    with fewer than 30 rows of prose, are compared with all of the field. The parts add up to ``distance2``.
    Empty tables give no rows.
    """
    kept = stage(stats, "statistics")
    medians = kept.groupBy(by).agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in STATS)).collect()  # a row per field
    params: dict = {(r[by], None): (np.array([r[c] for c in STATS], float), np.diag(1 / FLOORS**2)) for r in medians}
    for _ in range(rounds if params else 0):
        new = {}
        for g, (n, s, q) in _moments(kept, by, params, trim).items():
            if n >= 30:
                m = s / n
                new[g] = m, _precision(q / n - np.outer(m, m))
        params |= new
    found = params

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                parts = _scores(b, by, found)
                yield b.assign(distance2=parts.sum(1), **{f"part_{c}": parts[:, i] for i, c in enumerate(STATS)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "distance2 double", *(f"part_{c} double" for c in STATS)])
    return kept.mapInPandas(run, schema)


def not_prose(df: DataFrame, by: str, text: str, keep: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """Rows of ``distances`` whose squared distance is at least ``cutoff``."""
    return distances(statistics(df, text, [by, *keep]), by).where(F.col("distance2") >= cutoff)
