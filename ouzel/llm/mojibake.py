"""Text read with a wrong code page, treated as substitution ciphers.

A source is a page that bytes were shown in (such as cp1252) and a way of reading the bytes: in pairs and
longer units, as UTF-8 writes letters ("multi", also twice over), or one by one ("single"). Its cipher
symbols are these units. An expectation-maximization run per source learns which letter each unit stands
for: letters are judged by bigrams of the clean texts, given the unit's neighbours (themselves letters or
units with their present guesses). Public code charts are one part of the prior, whose weights are learnt;
a uniform part lets a unit take any letter. The learnt mapping is applied with ``str.translate``, after
units of several characters have been folded to one private character each. A text is affected if its
bigrams become much likelier that way, or if it holds characters that only failed decoding leaves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..session import stage
from .words import pieces, refuse_clash

#: Pages that UTF-8 bytes were shown in.
PAGES = ("cp1252", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "iso8859_15")
#: Pages of Cyrillic whose bytes were shown in another page.
SINGLE_TRUE = ("cp1251", "koi8_r", "mac_cyrillic", "cp866", "iso8859_5")
SINGLE_SHOWN = {"cyrillic": ("cp1251", "koi8_r", "mac_cyrillic", "cp866", "iso8859_5"), "western": ("cp1252",)}
#: The least gain in log-likelihood (nats) of a text that counts as affected.
GAIN = 1.0
#: The least gain for each letter that a single-byte cipher changes.
GAIN_EACH = 1.2
#: Mean log-likelihood of a letter (nats) below which a Cyrillic or accented text is looked at as a cipher.
ODD = -3.6
#: How far (nats) the letters of the oddest stretch of a text lie below ``ODD`` in all for it to be looked at.
STRETCH = 8.0
#: What a character outside the alphabet costs (nats) besides what the alphabet's one symbol for all of them does:
#: less for signs of Latin-1, nothing for scripts and emoji that texts have, and this for all others.
RARE, SIGN = 8.0, -4.0
_USED = ((0x100, 0x180), (0x370, 0x530), (0x2010, 0x2300), (0x2500, 0x27C0), (0x3000, 0xA000), (0xAC00, 0xD7B0), (0xFE0F, 0xFE10), (0xFF00, 0xFFF0), (0x1F000, 0x1FB00))
#: What a change between parts read as they are and parts deciphered costs (nats).
TURN = 4.0
_LOST = re.compile("[�\x80-\x9f]")
_PRIVATE = 0xF0000


def _symbols() -> list[str]:
    """The alphabet of the bigrams: plain, accented and Cyrillic small letters and common signs."""
    letters = [chr(i) for r in ((0x61, 0x7B), (0xDF, 0x180), (0x430, 0x460), (0x1E00, 0x1F00)) for i in range(*r)]
    letters = [c for c in letters if c.isalpha() and c == c.lower()]
    return [" ", "0", ".", "?", *letters, *"ă", *"’‘“”„–—…•€£¥§©®°½¼¾«»¿¡№™★☆❤→‹›"]


SYMBOLS = list(dict.fromkeys(_symbols()))
_INDEX = {c: i for i, c in enumerate(SYMBOLS)}
N = len(SYMBOLS)
_OTHER = _INDEX["?"]


@cache
def _symbol_table() -> np.ndarray:
    t = np.full(0x10000, _OTHER, np.int64)
    for i in range(0x10000):
        c = chr(i)
        low = c.lower()
        if low in _INDEX:
            t[i] = _INDEX[low]
        elif c.isspace():
            t[i] = 0
        elif c.isdigit():
            t[i] = 1
        elif i < 128:
            t[i] = 2
    return t


def indices(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _symbol_table()[np.minimum(codes, 0xFFFF)]


def _shown(page: str, byte: int) -> str:
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)


@cache
def _units(page: str, depth: int = 1) -> dict[str, str]:
    """Cipher units of a page and the letters that UTF-8 gives them, for letters of the alphabet."""
    out: dict[str, str] = {}
    # cp1252 stands for Latin-1 too, which shows bytes 80..9F as control characters
    forms = [lambda b: _shown(page, b)] + ([lambda b: chr(b)] if page == "cp1252" else [])
    letters = {c for s in SYMBOLS for c in (s, s.upper()) if len(c) == 1 and ord(c) > 127} | set(" ­😀😊👍😍😂🙂😉❤️")
    for c in sorted(letters):  # the order numbers the units alike in all processes
        for show in forms:
            s = c
            for _ in range(depth):
                s = "".join(show(b) if b > 127 else chr(b) for b in s.encode())
            out.setdefault(s, c)
    return out


def _rareness(text: str) -> float:
    outside = [ord(c) for c, i in zip(text, indices(text)) if i == _OTHER and ord(c) > 127]
    return sum(SIGN if c < 0x100 else 0.0 if any(a <= c < b for a, b in _USED) else RARE for c in outside)


@cache
def _bytes_of(page: str) -> dict[str, int]:
    """The byte that each shown character stands for."""
    out = {_shown(page, b): b for b in range(0x80, 0x100)}
    return out | {chr(b): b for b in range(0x80, 0x100) if chr(b) not in out} if page == "cp1252" else out


@cache
def _sequence(page: str) -> re.Pattern:
    """A pattern of what may be one letter's UTF-8 bytes shown in the page."""
    of = lambda lo, hi: "[" + re.escape("".join(c for c, b in _bytes_of(page).items() if lo <= b < hi)) + "]"
    go = of(0x80, 0xC0)
    return re.compile(f"{of(0xC2, 0xE0)}{go}|{of(0xE0, 0xF0)}{go}{{2}}|{of(0xF0, 0xF5)}{go}{{3}}")


def structural(text: str, page: str, known: dict[str, str]) -> str:
    """``text`` with every assigned letter or sign whose UTF-8 bytes the page shows, but for ``known`` units.

    Rare Latin letters, phonetic and modifying signs are left, as plain texts show their bytes more often.
    """

    def read(m: re.Match) -> str:
        if m[0] in known:
            return m[0]
        try:
            c = bytes(_bytes_of(page)[x] for x in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]
        odd = unicodedata.category(c) in ("Cn", "Co", "Cc", "Cf", "Mn") and c != "\ufe0f" or 0x180 <= ord(c) < 0x370 or 0x27C0 <= ord(c) < 0x3000
        return m[0] if odd else c

    return _sequence(page).sub(read, text)


def _pattern(units: dict[str, str]) -> re.Pattern:
    """A pattern of all units, longest first, by their first character."""
    by: dict[str, list[str]] = {}
    for u in sorted(units, key=len, reverse=True):
        by.setdefault(u[0], []).append(u[1:])
    return re.compile("|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, rest))})" for a, rest in by.items()))


@cache
def _charts(shown: str) -> dict[str, dict[str, str]]:
    """For each pair of pages, the letter that each shown character stands for."""
    out = {}
    for page in SINGLE_SHOWN[shown]:
        for true in SINGLE_TRUE:
            if page != true:
                chart = {}
                for b in range(0x80, 0x100):
                    try:
                        a, z = _shown(page, b), bytes([b]).decode(true)
                    except UnicodeDecodeError:
                        continue
                    if z.lower() in _INDEX and z.isalpha():
                        chart[a] = z
                out[f"{true} shown in {page}"] = chart
    return out


@dataclass
class Source:
    """A page and a way of reading; its units, each with its letter by each chart."""

    name: str
    charts: dict[str, dict[str, str]]
    mapping: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    single: bool = False

    def __post_init__(self) -> None:
        self._set([u for u in dict.fromkeys(u for c in self.charts.values() for u in c)])

    def _set(self, units: list[str]) -> None:
        self.units = units
        self.pattern = _pattern(dict.fromkeys(units, "")) if not self.single else re.compile("[" + re.escape("".join(units)) + "]")
        self.fold = {u: chr(_PRIVATE + i) for i, u in enumerate(units)}

    def folded(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.fold[m[0]], text)

    def decode(self, text: str, table: dict[int, str]) -> str:
        return self.folded(text).translate(table)

    def table(self) -> dict[int, str]:
        """For ``translate``: private characters to letters, or back to the unit where none was learnt."""
        return {ord(self.fold[u]): self.mapping.get(u, u) for u in self.units}


def sources() -> list[Source]:
    out = [Source(p, {"utf-8": _units(p)}) for p in PAGES]
    out += [Source(f"{p} twice", {"utf-8 twice": _units(p, 2)}) for p in ("cp1252", "mac_roman", "cp1250", "cp1251")]
    return out + [Source(f"single {s}", _charts(s), single=True) for s in SINGLE_SHOWN]


@cache
def _openings() -> np.ndarray:
    """The first two characters of all units of all pages, as sorted numbers."""
    return np.unique([min(ord(u[0]), 0xFFFF) << 16 | min(ord(u[1]), 0xFFFF) for p in PAGES for u in (*_units(p), *_units(p, 2))])


@cache
def _structure() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each page, how long a UTF-8 sequence that opens with a character is, and the characters that go on."""
    out = []
    for p in PAGES:
        length, more = np.zeros(0x10000, np.int8), np.zeros(0x10000, bool)
        for c, b in _bytes_of(p).items():
            length[ord(c)] = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            more[ord(c)] = b < 0xC0
        out.append((length, more))
    return out


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, 0xFFFF), np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))


def _maybe_units(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in which two characters follow each other as at the start of a unit of some page, and texts with what may be any UTF-8 sequence."""
    high = codes > 127
    at = np.nonzero(high[:-1] & high[1:])[0]
    third, fourth = (codes[np.minimum(at + k, len(codes) - 1)] for k in (2, 3))
    whole = np.zeros(len(at), bool)
    for length, more in _structure():
        n = length[codes[at]]
        whole |= (n > 0) & more[codes[at + 1]] & ((n < 3) | more[third]) & ((n < 4) | more[fourth])
    pair = codes[at].astype(np.int64) << 16 | codes[at + 1]
    place = np.minimum(np.searchsorted(_openings(), pair), len(_openings()) - 1)
    hit = _openings()[place] == pair
    out = np.zeros(len(ends), bool)
    out[np.searchsorted(ends, at[hit], "right")] = True
    return out, np.bincount(np.searchsorted(ends, at[whole], "right"), minlength=len(ends)) > 0


def bigrams(df: DataFrame, text: str) -> np.ndarray:
    """Counts of symbols of ``SYMBOLS`` after each other over all texts that look clean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N * N, np.int64)
        for b in pieces(batches, "t"):
            codes, ends = _flat(b["t"].tolist())
            units, whole = _maybe_units(codes, ends)
            clean = ~(units | whole)
            use = np.repeat(clean, np.diff(np.append(0, ends)))
            s = _symbol_table()[codes]
            total += np.bincount((s[:-1] * N + s[1:])[use[1:]], minlength=N * N)
        k = np.nonzero(total)[0]
        yield pd.DataFrame({"k": k, "n": total[k]})

    rows = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(N * N)  # the alphabet bounds what is collected
    out[rows["k"]] = rows["n"]
    return out.reshape(N, N)


def log_probabilities(n: np.ndarray) -> np.ndarray:
    """log P(symbol | symbol before), smoothed by the symbol's own share."""
    own = (n.sum(0) + 0.1) / (n.sum() + 0.1 * N)
    own[_OTHER] = min(own[_OTHER], 1e-6)
    p = (n + 3 * own) / (n.sum(1, keepdims=True) + 3)
    p[:, _OTHER] = np.minimum(p[:, _OTHER], 1e-6)
    return np.log(p)


def _scripts() -> tuple[np.ndarray, np.ndarray]:
    cyr = np.array([0x430 <= ord(c) < 0x460 for c in SYMBOLS])
    western = np.array([0xDF <= ord(c) < 0x100 for c in SYMBOLS])
    return cyr, western


def _odd_scores(s: np.ndarray, ll: np.ndarray, script: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """For each symbol, how much less likely than ``ODD`` it is as a letter of the script after another."""
    mine = script[s] & np.append(False, script[s[:-1]])
    return np.where(mine, np.clip(ODD - ll, -4, 3), np.where(plain[s], -0.2, 0.0))


def _oddest(score: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The greatest sum of a stretch within each text."""
    starts = np.append(0, ends[:-1])
    upto = np.cumsum(score)
    before = upto - score
    # each text lies wholly below the one before, so that running minima start anew
    low = np.repeat(np.arange(len(ends)) * (2 * np.abs(score).sum() + 1), ends - starts)
    least = np.minimum.accumulate(before - low) + low
    return np.maximum.reduceat(upto - least, starts)


def odd_part(text: str, logp: np.ndarray, script: np.ndarray, plain: np.ndarray) -> str:
    """The words of the oddest stretch of a text."""
    s = indices(" " + text + " ")
    score = _odd_scores(s, np.append(0, logp[s[:-1], s[1:]]), script, plain)
    upto = np.append(0, np.cumsum(score))
    least = np.minimum.accumulate(upto)
    end = int(np.argmax(upto - least))
    start = int(np.argmin(upto[: end + 1]))
    padded = " " + text + " "
    return padded[padded.rfind(" ", 0, start + 1) + 1 : (padded + " ").find(" ", max(end - 1, 0))]


def _plain() -> np.ndarray:
    return np.array([c.isalpha() and c.isascii() for c in SYMBOLS])


def suspects(df: DataFrame, text: str, keep: list[str], logp: np.ndarray) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``kind`` (bits: 1 units, 2 lost, 4 and 8 odd letters of a script, 16 and 32 in a part)."""
    src = df.select(*keep, F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    cyr, western = _scripts()
    plain = _plain()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches, "text"):
            texts = b["text"].tolist()
            codes, ends = _flat(texts)
            starts = np.append(0, ends[:-1])
            s = _symbol_table()[codes]
            ll = np.append(0, logp[s[:-1], s[1:]])
            units, whole = _maybe_units(codes, ends)
            kind = (units | whole).astype(np.int64)
            lost = (codes == 0xFFFD) | ((codes >= 0x80) & (codes < 0xA0))
            kind |= 2 * (np.add.reduceat(lost, starts, dtype=np.int64) > 0)
            for bit, script, least in ((4, cyr, 0.3), (8, western, 0.5)):
                mine = script[s] & np.append(False, script[s[:-1]])  # letters of the script after another
                count = np.add.reduceat(mine, starts, dtype=np.int64)
                mean = np.add.reduceat(np.where(mine, ll, 0), starts) / np.maximum(count, 1)
                alpha = np.add.reduceat(script[s] | plain[s], starts, dtype=np.int64)
                whole = (count >= 4) & (mean < ODD) & (count >= least * alpha * 0.5)
                part = _oddest(_odd_scores(s, ll, script, plain), ends) >= STRETCH
                kind |= np.where(whole, bit, np.where(part, bit * 4, 0))
            yield b[kind > 0].assign(kind=kind[kind > 0])

    cols = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInPandas(run, f"{cols}, text string, kind int")


def _for_kind(all_: list[Source], kind: int) -> list[Source]:
    return [s for s in all_ if (not s.single and kind & 1) or (s.name == "single cyrillic" and kind & 20) or (s.name == "single western" and kind & 40)]


def neighbours(found: DataFrame, logp: np.ndarray) -> pd.DataFrame:
    """Counts of what stands before and after each unit of each source, over all suspects.

    A cipher of single characters uses letters of clean texts, so of a text that isn't odd as a whole only the oddest part tells of it.
    """
    scripts = dict(zip(("single cyrillic", "single western"), _scripts()))
    plain = _plain()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = sources()
        acc: Counter = Counter()
        table = _symbol_table()
        as_token = lambda c: N + ord(c) - _PRIVATE if ord(c) >= _PRIVATE else int(table[min(ord(c), 0xFFFF)])
        for b in batches:
            for t, kind in zip(b["text"], b["kind"]):
                for s in _for_kind(all_, kind):
                    part = t
                    if s.single and not kind & (4 if s.name == "single cyrillic" else 8):
                        part = odd_part(t, logp, scripts[s.name], plain)
                    f = " " + s.folded(part) + " "
                    if f.strip() == part.strip():
                        continue
                    acc.update({(s.name, -1, int(k)): int(n) for k, n in zip(*np.unique(indices(f), return_counts=True))})
                    for m in re.finditer(f"[{chr(_PRIVATE)}-{chr(_PRIVATE + 0xFFFD)}]", f):
                        i = m.start()
                        me = as_token(f[i])
                        acc[s.name, as_token(f[i - 1]), me] += 1
                        after = as_token(f[i + 1])
                        if after < N:  # pairs of units are counted at the second one
                            acc[s.name, me, after] += 1
        yield pd.DataFrame([(*k, n) for k, n in acc.items()], columns=["source", "a", "b", "n"])

    # Bounded by the alphabet: units and symbols are fixed lists.
    return found.select("text", "kind").mapInPandas(run, "source string, a int, b int, n long").groupBy("source", "a", "b").agg(F.sum("n").alias("n")).toPandas()


def learn(source: Source, pairs: pd.DataFrame, logp: np.ndarray, rounds: int = 12, free: float = 0.05) -> None:
    """Set the source's mapping by expectation-maximization from counts of neighbours.

    The hidden letter z of unit u has the weight P(z | before) P(after | z) P(u | z). P(u | z) is a mixture:
    with the charts' weights, 1 where the chart gives z for u; with the rest, a free cipher. Each round
    estimates the weights and the free cipher anew from expected counts. In the free cipher a letter also
    shows as itself, as often as it does in the source's suspects, so that common letters are no home for
    everything. A source whose charts don't fit thus becomes a plain substitution cipher.
    """
    shows = np.zeros(N)
    itself = pairs[pairs["a"] < 0]
    shows[itself["b"]] = itself["n"]
    pairs = pairs[pairs["a"] >= 0]
    a, b, n = pairs["a"].to_numpy(), pairs["b"].to_numpy(), pairs["n"].to_numpy(float)
    seen = np.unique(np.concatenate([a[a >= N], b[b >= N]]) - N)
    if not len(seen):
        source.mapping = {}
        return
    place = {int(u): i for i, u in enumerate(seen)}
    m = len(seen)
    before, after, both = np.zeros((m, N)), np.zeros((m, N)), np.zeros((m, m))
    for x, y, c in zip(a, b, n):
        if x >= N and y >= N:
            both[place[x - N], place[y - N]] += c
        elif y >= N:
            before[place[y - N], x] += c
        else:
            after[place[x - N], y] += c
    known = before @ logp + after @ logp.T
    count = np.maximum(before.sum(1) + both.sum(0), 1)
    charts = list(source.charts.values())
    target = np.full((len(charts), m), -1)
    for k, chart in enumerate(charts):
        for i, u in enumerate(seen):
            z = chart.get(source.units[u])
            if z is not None:
                target[k, i] = _INDEX.get(z.lower(), _OTHER)
    hot = np.zeros((len(charts), m, N), np.float32)
    for k in range(len(charts)):
        has = np.nonzero(target[k] >= 0)[0]
        hot[k, has, target[k][has]] = 1
    w, eps, theta, q = np.full(len(charts), (1 - free) / len(charts)), free, np.full((m, N), 1 / N), None
    for _ in range(rounds):
        by_chart = np.tensordot(w, hot, 1)
        emission = by_chart + eps * theta + 1e-12
        if q is None:
            q = emission / emission.sum(1, keepdims=True)
        score = known + both.T @ (q @ logp) + both @ (q @ logp.T) + count[:, None] * np.log(emission)
        score -= score.max(1, keepdims=True)
        q = np.exp(score)
        q /= q.sum(1, keepdims=True)
        used = count[:, None] * q / emission
        w = w * (hot * used).sum((1, 2)) + 1e-3
        freely = used * eps * theta
        eps = freely.sum() + 1e-3
        theta = (freely + 1e-3) / (shows + freely.sum(0) + 1e-3 * m)
        w, eps = w / (w.sum() + eps), max(eps / (w.sum() + eps), 1e-4)
    source.weights = dict(zip(source.charts, w.tolist()))
    best = q.argmax(1)
    source.mapping = {}
    for i, u in enumerate(seen):
        unit, letter = source.units[u], SYMBOLS[best[i]]
        if best[i] in (_OTHER, 0, 1, 2):  # no letter: the likeliest chart's own sign, if it has one
            letter = None
        for k in np.argsort(-w):
            z = charts[k].get(unit)
            if z is not None and (letter is None or z.lower() == letter):
                letter = z  # the chart also knows the case
                break
        if letter is not None and (source.single or letter == charts[0].get(unit)):  # a unit of several bytes is learnt where both agree
            source.mapping[unit] = letter


def likelihood(text: str, logp: np.ndarray) -> float:
    s = indices(" " + text + " ")
    return float(logp[s[:-1], s[1:]].sum())


def by_parts(text: str, other: str, logp: np.ndarray) -> tuple[str, float]:
    """The likeliest mixture of two readings of the same length, word by word, and its gain over ``text``.

    Each changed letter has to gain ``GAIN_EACH`` on average, and each deciphered part ``TURN`` besides, but for
    one that is the whole text.
    """
    a, b = indices(" " + text + " "), indices(" " + other + " ")
    gain = logp[b[:-1], b[1:]] - logp[a[:-1], a[1:]]
    changed = np.append(np.array([x != y for x, y in zip(text, other)], bool), False)
    net = gain - GAIN_EACH * changed
    first = np.append(0, np.nonzero(a[1:-1] == 0)[0] + 1)  # a word goes from after a blank through the next one
    first = first[first <= len(text)]
    reward, gains = np.add.reduceat(net, first), np.add.reduceat(gain, first)
    clean, odd, back = 0.0, -TURN, []
    for r in reward:
        back.append((odd > clean, odd >= clean - TURN))
        clean, odd = max(clean, odd), max(odd, clean - TURN) + r
    take, state = np.zeros(len(first), bool), bool(odd > clean)
    for i in range(len(first) - 1, -1, -1):
        take[i] = state
        state = back[i][1] if state else back[i][0]
    if reward.sum() > 0 and reward.sum() >= reward[take].sum() - TURN:
        take[:] = True
    if not take.any():
        return text, 0.0
    use = np.repeat(take, np.diff(np.append(first, len(text) + 1)))[: len(text)]
    return "".join(y if u else x for x, y, u in zip(text, other, use)), float(gains[take].sum())


def restore(text: str, learnt: list[tuple[Source, dict[int, str]]], kind: int, logp: np.ndarray) -> tuple[str, float, str]:
    """The likeliest reading, its gain in log-likelihood and the sources that gave it (at most 3)."""
    gain, names = 0.0, []
    now = likelihood(text, logp)
    mine = _for_kind([s for s, _ in learnt], kind)
    for _ in range(3):
        best = None
        for s, table in learnt:
            if s in mine and (t := s.decode(text, table)) != text:
                if s.single and len(t) == len(text):
                    t, more = by_parts(text, t, logp)
                    x, least = now + more, 0.0
                else:
                    x, least = likelihood(t, logp), 1.0
                if x > now + least and (best is None or x > best[0]):
                    best = x, t, s.name
        if best is None and kind & 1:  # what the learnt ciphers leave
            for page in PAGES:
                t = structural(text, page, _units(page))
                if t != text:
                    x = likelihood(t, logp)
                    if x > now + 1.0 + max(_rareness(t) - _rareness(text), 0.0) and (best is None or x > best[0]):
                        best = x, t, f"{page} by structure"
        if best is None:
            break
        gain, now, text = gain + best[0] - now, best[0], best[1]
        names.append(best[2])
    return text, gain, ", ".join(names)


def garbled(df: DataFrame, text: str, keep: list[str], least_gain: float = GAIN) -> DataFrame:
    """Rows with garbled text: the ``keep`` columns, ``text``, ``restored``, ``gain``, ``source``, ``lost``.

    ``restored`` is the text in the learnt reading (whole or part; where nothing could be learnt it stays
    as it is), ``source`` says which ciphers were undone, ``lost`` whether characters are gone for good.
    Foreign letters, signs and emoji that fit the bigrams of clean texts aren't affected. Null, empty and
    plain ASCII texts never are. Repeated rows each give a row; empty tables give none.
    """
    refuse_clash(keep, ("text", "restored", "gain", "source", "lost", "kind", "_t"))
    src = df.select(*keep, F.col(text).alias("_t"))
    logp = log_probabilities(bigrams(src, "_t"))
    found = stage(suspects(src, "_t", keep, logp), "suspects")
    counts = neighbours(found, logp)
    learnt = []
    for s in sources():
        learn(s, counts[counts["source"] == s.name], logp)
        if s.mapping:
            learnt.append((s.name, s.mapping))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_name = {s.name: s for s in sources()}
        ready = []
        for name, mapping in learnt:
            by_name[name].mapping = mapping
            ready.append((by_name[name], by_name[name].table()))
        for b in batches:
            if not len(b):
                continue
            done = [restore(t, ready, k, logp) for t, k in zip(b["text"], b["kind"])]
            lost = np.array([bool(_LOST.search(t)) for t, _, _ in done], bool)
            gain = np.array([g for _, g, _ in done])
            out = b.drop(columns="kind").assign(restored=[t for t, _, _ in done], gain=gain, source=[n for _, _, n in done], lost=lost)
            yield out[(gain >= least_gain) | lost | np.array([bool(_LOST.search(t)) for t in b["text"]], bool)]

    cols = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)
    return found.mapInPandas(run, f"{cols}, text string, restored string, gain double, source string, lost boolean")
