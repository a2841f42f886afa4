"""Near copies of texts by fuzzy hashing with the binary Golay code (23, 12, 7).

The code is perfect: each 23-bit vector lies within three bits of exactly one of 4096 codewords. A
vector and its 23 neighbours therefore decode to one or six codewords, and two vectors that differ in
at most two bits always share one of them.

A text's fingerprint has several segments. A segment stands for two anchors, the least of the text's shingles by
two hash functions, and holds two 23-bit vectors of one-bit minimum hashes: one over the words around the first
anchor, which a block added elsewhere leaves alone, and one over all words, which moved parts leave alone. Two texts
are candidates if a segment has equal anchors and either vector shares a codeword index. By the pigeonhole principle,
fewer than 3 * s errors in the s segments with equal anchors leave one that does. A codeword index alone has 12 bits,
too few for large collections, and anchors alone gather all texts with a common phrase; together they keep
buckets small.

Rows are shuffled by anchors and decoded where they meet, so that a segment is sent once and not once for each of its
indices. Where many texts meet, a third anchor must be equal, from any of ``MORE`` other segments, and a fourth where these
are many too; ``segments_for`` reckons with what that may miss. Ten bits of each go with the row for that, so that it is still
sent once. Only where a sample shows more texts than one task should gather are rows sent by the third and fourth anchor
instead, and buckets that are large even so are spread over their codeword indices and pairs of blocks, which changes where
a pair is found, not which pairs are. Segments are shuffled in ``PASSES`` passes, each of which frees its disk.

Candidates are compared by an upper bound of their similarity, which no true pair can fall below, then exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..session import drop_staged, is_small, stage
from .words import mix, pieces, shingle_hashes, word_hashes

#: The generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the code.
GENERATOR = 0b101011100011
BITS = 23
#: 64-bit words of the print that candidates are compared by.
WIDE = 3
#: Steps of a text's size (as ``SIZES`` times a logarithm) that go with its vectors.
SIZES = 64
#: The greatest chance that segments miss a pair at the threshold, if vectors with equal anchors share an index in at least ``SHARE`` of cases.
MISS, SHARE = 0.001, 0.9
#: Words on each side of an anchor that its vector is drawn from, and how many vectors over all words there are.
AROUND, WHOLE = 12, 3
#: ``COMMON`` texts with equal anchors need one more in common. A text in ``SAMPLED`` is counted to find anchors of more than ``BLOCK`` texts, and such a bucket is compared in blocks of as many.
SAMPLED, COMMON, BLOCK = 64, 24, 8192
#: How often common anchors take one more, from how many segments, and how many bits of it go with a row.
DEPTH, MORE, BIT = 2, 3, 10
#: In how many parts the segments are shuffled, one after the other.
PASSES = 3
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


class Golay:
    """Decoding tables: the remainder (syndrome) of a vector tells its error pattern."""

    def __init__(self) -> None:
        self.low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
        self.high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        for weight in range(4):
            for places in itertools.combinations(range(BITS), weight):
                v = sum(1 << p for p in places)
                self.error[self.low[v & 4095] ^ self.high[v >> 12]] = v

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The index (0..4095) of the nearest codeword."""
        return (x ^ self.error[self.low[x & 4095] ^ self.high[x >> 12]]) >> 11

    def indices(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and codeword indices of each vector and all its neighbours, without repeats."""
        around = np.stack([self.decode(x)] + [self.decode(x ^ (1 << i)) for i in range(BITS)], 1)
        around.sort(axis=1)
        fresh = np.ones(around.shape, bool)
        fresh[:, 1:] = around[:, 1:] != around[:, :-1]
        rows, cols = np.nonzero(fresh)
        return rows, around[rows, cols]


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


def _odd_constants(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1)) | np.uint64(1)



def _hashes(values: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """``count`` 32-bit hash functions of 64-bit values."""
    narrow = (values >> np.uint64(32)).astype(np.uint32)
    other = values.astype(np.uint32)
    for c in _odd_constants(count, seed):
        h = narrow * np.uint32(int(c) & 0xFFFFFFFF | 1)
        h ^= h >> np.uint32(15)
        h += other * np.uint32(int(c) >> 32 | 1)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x85EBCA6B)
        yield h


def segments_for(threshold: float) -> int:
    """How many segments miss a pair at ``threshold`` in at most ``MISS`` of cases, even if all their anchors are common."""
    hit = SHARE * threshold**2 * (1 - (1 - threshold) ** MORE) ** DEPTH
    return max(1, math.ceil(math.log(MISS) / math.log1p(-hit)))


def _vectors(least: Iterator[np.ndarray], count: int, n: int) -> np.ndarray:
    """``count`` 23-bit vectors of one-bit minimum hashes for each of ``n`` texts."""
    out = np.zeros((n, count), np.int32)
    for i, h in enumerate(least):
        out[:, i // BITS] |= ((h >> np.uint32(9)) & np.uint32(1)).astype(np.int32) << np.int32(i % BITS)
    return out


def _least_around(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each of ``BITS`` hash functions, its least value over the ``width`` words from ``AROUND`` before each word on.

    Texts lie ``AROUND`` apart, so that text k's first word is at its start plus k times as many places; no window reaches into
    another text, as long as ``width`` is no more than twice that and a shingle, which starts within a text.
    """
    at = np.arange(len(words)) + np.repeat(AROUND * np.arange(1, len(sizes) + 1), sizes)
    n = len(words) + AROUND * (len(sizes) + 1) + width
    for h in _hashes(words, BITS, 47):
        x = np.full(n, 0xFFFFFFFF, np.uint32)
        x[at] = h
        have = 1
        while have < width:
            step = min(have, width - have)
            x = np.minimum(x[:-step], x[step:])
            have += step
        yield x


def _print(grams: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingles hashed to 64 * ``WIDE`` bits, and the number of different shingles."""
    h = grams >> np.uint64(32)  # what shingles are compared by
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    each = np.bincount((np.unique(row << np.uint64(32) | h) >> np.uint64(32)).astype(np.int64), minlength=len(counts))
    place = mix(h ^ _SALT) % np.uint64(64 * WIDE)
    bit = np.uint64(1) << (place & np.uint64(63))
    wide = np.stack([np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), starts) for k in range(WIDE)], 1)
    return wide.view(np.int64), each


def may_reach(threshold: float) -> Column:
    """Whether texts with the prints ``wide_a, n_a`` and ``wide_b, n_b`` may have a similarity of ``threshold``.

    A bit that only one print has stands for at least one shingle that only this text has. So many at least are
    missing from what both have in common, and a pair that is ruled out lies below the threshold for certain.
    """
    own_a, own_b = (sum((F.bit_count(F.col(f"wide_{x}")[k].bitwiseAND(F.bitwise_not(F.col(f"wide_{y}")[k]))) for k in range(WIDE)), F.lit(0)) for x, y in ("ab", "ba"))
    common = F.least(F.col("n_a") - own_a, F.col("n_b") - own_b)
    return (1 + threshold) * common >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6


def fingerprints(texts: list[str], segments: int, shingle: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Of texts with at least ``min_words`` words: their places, anchors (two for each segment), vectors around them, vectors over all words, prints, shingles."""
    flat, sizes = word_hashes(texts)
    keep = sizes >= max(min_words, shingle)
    flat = flat[np.repeat(keep, sizes)]
    sizes, places = sizes[keep], np.nonzero(keep)[0]
    n = len(places)
    if not n:
        return places, np.zeros((0, 2 * segments), np.int32), np.zeros((0, segments), np.int32), np.zeros((0, WHOLE), np.int32), np.zeros((0, WIDE), np.int64), places
    grams, counts = shingle_hashes(flat, sizes, shingle)
    ends = np.cumsum(sizes)
    starts, gram_starts = ends - sizes, np.cumsum(counts) - counts
    mixed = mix(flat)
    whole = _vectors((np.minimum.reduceat(h, starts) for h in _hashes(mixed, WHOLE * BITS, 11)), WHOLE, n)
    anchors, near = np.zeros((n, 2 * segments), np.uint32), np.zeros((n, segments), np.int32)
    ahead = np.zeros((n, segments), np.int64)
    for i, h in enumerate(_hashes(grams, 2 * segments, 29)):
        anchors[:, i] = least = np.minimum.reduceat(h, gram_starts)
        if i % 2 == 0:
            at = np.nonzero(h == np.repeat(least, counts))[0]
            ahead[:, i // 2] = at[np.searchsorted(at, gram_starts)] - gram_starts
    # Like texts have like words around, which ``mixed`` words stand for; all segments may use the same hash functions.
    for i, least in enumerate(_least_around(mixed, sizes, starts, 2 * AROUND + shingle)):
        near |= ((least[ahead + (starts + AROUND * np.arange(n))[:, None]] >> np.uint32(9)) & np.uint32(1)).astype(np.int32) << np.int32(i)
    wide, each = _print(grams, gram_starts, counts)
    return places, anchors.view(np.int32), near, whole, wide, each


def _fingerprint_stage(segments: int, shingle: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches, "text"):
            places, anchors, near, whole, wide, each = fingerprints(b["text"].tolist(), segments, shingle, min_words)
            b = b.iloc[places]
            yield pd.DataFrame({
                "field": b["field"].to_numpy(),
                "id": b["id"].to_numpy(),
                "digest": b["digest"].to_numpy(),
                "anchor": list(anchors),
                "near": list(near),
                "whole": list(whole),
                "wide": list(wide),
                "n": each,
            })

    return run


def _indices_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codeword indices of the two packed vectors of each row, those over all words with a 13th bit."""
    (r, i), (q, j) = golay().indices(vectors & (1 << BITS) - 1), golay().indices(vectors >> BITS & (1 << BITS) - 1)
    return np.concatenate([r, q]), np.concatenate([i, j | 4096])


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with common anchors, one for each codeword index and, in large buckets, pair of blocks.

    A text of block b goes to the pairs (b, j) and (j, b) of blocks; the place of the vectors, which are used up, tells
    by -1 or -2 its place there, or by -3 that it is (b, b).
    """
    for b in batches:
        if not len(b):
            continue
        rows, index = _indices_of(b["vectors"].to_numpy())
        u, key = b["u"].to_numpy()[rows], b["key"].to_numpy().view(np.uint64)[rows]
        key = mix(key ^ mix(index.astype(np.uint64) + np.uint64(1)))
        blocks = -(-b["common"].to_numpy()[rows] * SAMPLED // BLOCK)
        own = (mix(u.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        many = np.repeat(np.arange(len(u)), blocks)
        other = np.arange(len(many)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own = own[many]
        pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
        side = np.where(own == other, -3, np.where(own < other, -1, -2))
        yield pd.DataFrame({"key": mix(key[many] ^ mix(pair + _SALT)).view(np.int64), "u": u[many], "vectors": side})


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.nonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))[0] if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _within(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of entries of ``order`` within each run, some ``most`` at once."""
    for size in np.unique(sizes[sizes > 1]):
        first = starts[sizes == size]
        if size <= 512:
            i, j = np.triu_indices(size, 1)
            step = max(1, most // len(i))
            for k in range(0, len(first), step):
                m = order[first[k : k + step, None] + np.arange(size)]
                yield m[:, i].ravel(), m[:, j].ravel()
        else:
            step = max(1, most // int(size))
            for f in first:
                m = order[f : f + size]
                for k in range(0, size, step):
                    i, j = np.meshgrid(np.arange(k, min(k + step, size)), np.arange(size), indexing="ij")
                    ok = i < j
                    yield m[i[ok]], m[j[ok]]


def _across(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of an entry of side -1 and one of side -2 within each run."""
    for f, size in zip(starts[sizes > 1], sizes[sizes > 1]):
        m = order[f : f + size]
        x, y = m[side[m] == -1], m[side[m] == -2]
        step = max(1, most // max(len(y), 1))
        for k in range(0, len(x) if len(y) else 0, step):
            yield np.repeat(x[k : k + step], len(y)), np.tile(y, len(x[k : k + step]))


def _narrowed(at: np.ndarray, group: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` and their groups, those of groups of ``COMMON`` rows or more once for each further anchor, in groups that share it.

    ``more`` has ``MORE`` further anchors for each of ``DEPTH`` steps, and above them the steps already taken.
    """
    for step in range(DEPTH):
        often = (np.bincount(group)[group] >= COMMON) & (more[at] >> BIT * MORE * DEPTH <= step)
        if often.any():
            deep = at[often]
            which = np.tile(np.arange(MORE), len(deep))
            value = more[np.repeat(deep, MORE)] >> BIT * (MORE * (DEPTH - 1 - step) + which) & (1 << BIT) - 1
            group = np.concatenate([(group[~often] * (MORE + 1) + MORE) << BIT, (np.repeat(group[often], MORE) * (MORE + 1) + which) << BIT | value])
            at = np.concatenate([at[~often], np.repeat(deep, MORE)])
            _, group, sizes = np.unique(group, return_inverse=True, return_counts=True)
            at, group = at[sizes[group] > 1], group[sizes[group] > 1]
    return at, group


def _pairs_of(b: pd.DataFrame, apart: int) -> Iterator[pd.DataFrame]:
    """Candidates among rows sorted by key, whose last key is whole, with sizes at most ``apart`` steps apart.

    Rows without ``more`` need no further anchors.
    """
    key, u, vectors = b["key"].to_numpy(), b["u"].to_numpy(), b["vectors"].to_numpy()
    starts, sizes = _runs(key)
    run = np.repeat(np.arange(len(sizes)), sizes)
    plain = np.nonzero((sizes[run] > 1) & (vectors >= 0))[0]
    group = run[plain]
    if "more" in b and len(plain):
        plain, group = _narrowed(plain, group, b["more"].to_numpy())
    found = [_coded(plain, group, vectors)]
    first = vectors[starts]
    found.append(_within(np.arange(len(key)), starts, np.where(first == -3, sizes, 0)))
    found.append(_across(np.arange(len(key)), starts, np.where((first < 0) & (first > -3), sizes, 0), vectors))
    size = vectors >> 2 * BITS
    for i, j in itertools.chain(*found):
        like = np.nonzero((np.abs(size[i] - size[j]) <= apart) | (vectors[i] < 0))[0]
        i, j = i[like], j[like]
        x, y = np.minimum(u[i], u[j]), np.maximum(u[i], u[j])
        yield pd.DataFrame({"u_a": x, "u_b": y})[x != y].drop_duplicates()


def _coded(at: np.ndarray, group: np.ndarray, vectors: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows ``at`` in one group that share a codeword index, of some ``most`` rows at once."""
    by = np.argsort(group, kind="stable")
    at, group = at[by], group[by]
    start = 0
    while start < len(at):
        end = int(np.searchsorted(group, group[min(start + most, len(at)) - 1], "right"))
        rows, index = _indices_of(vectors[at[start:end]])
        code = group[start:end][rows] << 13 | index
        by = np.argsort(code, kind="stable")
        yield from _within(at[start:end][rows[by]], *_runs(code[by]))
        start = end


def _candidate_stage(threshold: float):
    # Two rounded logarithms may differ by one step more than the logarithms do.
    apart = math.ceil(-SIZES * math.log(threshold)) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                if sum(map(len, held)) < 200_000:
                    continue
            if not held:
                return
            rows = pd.concat(held, ignore_index=True)
            key = rows["key"].to_numpy()
            cut = len(rows) if b is None or not len(rows) else int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield from _pairs_of(rows[:cut], apart)
            held = [rows[cut:]] if cut < len(rows) else []

    return run


def _shingle_stage(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches, "text"):
            flat, sizes = word_hashes(b["text"].tolist())
            grams, counts = shingle_hashes(flat, sizes, shingle)
            parts = np.split((grams >> np.uint64(32)).astype(np.uint32).view(np.int32), np.cumsum(counts)[:-1]) if len(counts) else []
            yield pd.DataFrame({"u": b["u"], "s": [np.unique(p) for p in parts]})

    return run


def candidates(prints: DataFrame, segments: int, threshold: float) -> DataFrame:
    """Pairs ``(u_a, u_b)``, ``u_a`` < ``u_b``, of ``prints(u, field, anchor, near, whole, n)`` with equal anchors in a segment and a codeword index in common there.

    Where the first two anchors are common, so must be a third and fourth one, of any of ``MORE`` segments each. Pairs of
    which one has too few shingles for a similarity of ``threshold`` are left out.
    """
    s, anchor = F.col("s"), F.col("anchor")
    size = F.floor(SIZES * F.log(F.col("n"))).cast("long")

    def further(step: int) -> list[Column]:
        return [anchor[2 * ((s + MORE * step + j) % segments)] for j in range(1, MORE + 1)]

    def rows_of(prints: DataFrame, own: list[int]) -> DataFrame:
        each = prints.select("u", "field", "anchor", "near", "whole", size.alias("size"), F.explode(F.array(*map(F.lit, own))).alias("s"))
        vectors = F.shiftleft("size", 2 * BITS).bitwiseOR(F.shiftleft(F.col("whole")[s % WHOLE].cast("long"), BITS)).bitwiseOR(F.col("near")[s].cast("long"))
        more = F.lit(0).cast("long")
        for step in range(DEPTH):
            for k, a in enumerate(further(step)):
                more = more.bitwiseOR(F.shiftleft(a.bitwiseAND((1 << BIT) - 1).cast("long"), BIT * (MORE * (DEPTH - 1 - step) + k)))
        return each.select("u", vectors.alias("vectors"), more.alias("more"), F.xxhash64("field", "s", anchor[2 * s], anchor[2 * s + 1]).alias("key"), "s", "anchor")

    def deeper(rows: DataFrame, often: DataFrame, step: int) -> DataFrame:
        """The rows of too common anchors, by one more."""
        other = F.array(*(F.xxhash64("key", a) for a in further(step)))
        taken = F.shiftleft(F.lit(1).cast("long"), BIT * MORE * DEPTH)
        return rows.join(F.broadcast(often), "key", "left_semi").select("u", "vectors", (F.col("more") + taken).alias("more"), F.explode(other).alias("key"), "s", "anchor")

    # a key in ``often`` has some BLOCK rows, so they are few enough to be sent out
    often: list[DataFrame] = []
    rows = rows_of(prints.where(F.pmod(F.xxhash64("u"), F.lit(SAMPLED)) == 0), list(range(segments)))
    for step in range(DEPTH + 1):
        counted = rows.groupBy("key").agg(F.count("*").alias("common"))
        often.append(stage(counted.where(F.col("common") >= BLOCK // SAMPLED), "common", free=True))
        if often[-1].isEmpty():
            break
        if step < DEPTH:
            rows = deeper(rows, often[-1], step)

    found = []
    for part in range(min(PASSES, segments)):
        rows, every = rows_of(prints, list(range(part, segments, PASSES))), []
        for step, o in enumerate(often):
            every.append((rows if o.isEmpty() else rows.join(F.broadcast(o), "key", "left_anti")).select("key", "u", "vectors", "more"))
            if not o.isEmpty():
                rows = deeper(rows, o, step) if step < DEPTH else rows.join(F.broadcast(o), "key").select("key", "u", "vectors", "common")
        if len(often) > DEPTH and not often[DEPTH].isEmpty():
            every.append(rows.mapInPandas(_spread, "key long, u long, vectors long").withColumn("more", F.lit(DEPTH).cast("long") * (1 << BIT * MORE * DEPTH)))
        sent = reduce(DataFrame.unionAll, every).repartition("key").sortWithinPartitions("key")
        found.append(stage(sent.mapInPandas(_candidate_stage(threshold), "u_a long, u_b long"), "part", free=True))
    out = stage(reduce(DataFrame.unionAll, found).distinct(), "candidates", free=True)
    for part in found:
        drop_staged(part)
    return out


def _bits(rows: DataFrame) -> DataFrame:
    """``bucket, bits``: the numbers ``u`` as bitmaps of 4 KB for 32,768 of them."""
    return rows.groupBy(F.bitmap_bucket_number("u").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("u")).alias("bits"))


def _without(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The ``rows`` whose ``u`` isn't in ``bitmaps``, which is sent out: 12.5 MB for 100 million texts."""
    place = F.bitmap_bit_position("u")
    byte = F.conv(F.hex(F.substring("bits", F.expr("int(bitmap_bit_position(u) div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bitmaps), (F.bitmap_bucket_number("u") == F.col("bucket")) & (F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1), "left_anti")


def near_copies(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 20, segments: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near copies among ``docs(field string, id string, text string)``, within each field.

    Returns ``members(u, field, id, rep)``: one row per text of at least ``min_words`` words, ``rep``
    being the ``u`` of the first row with the same text; ``pairs(rep_a, rep_b, similarity)``: different
    texts whose sets of ``shingle`` consecutive words have a Jaccard similarity of at least
    ``threshold``; and ``copies(rep, n)``: texts that occur ``n`` > 1 times. Null texts, texts with
    fewer words and empty tables give no rows. Word order and case follow the text; a text of any
    length is read whole. Each pair of candidates is compared exactly, unless its prints prove that it lies
    below the threshold. There are as many segments as ``segments_for`` says, unless ``segments`` is given.
    """
    segments = segments or segments_for(threshold)
    present = docs.where(F.col("text").isNotNull()).select("field", F.col("id").cast("string").alias("id"), F.unhex(F.md5("text")).alias("digest"), "text")
    whole = stage(
        present.mapInPandas(_fingerprint_stage(segments, shingle, min_words), "field string, id string, digest binary, anchor array<int>, near array<int>, whole array<int>, wide array<long>, n int").withColumn("u", F.monotonically_increasing_id()),
        "fingerprints",
    )
    copies = stage(whole.groupBy("field", "digest").agg(F.min("u").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies", free=True)
    later = stage(_bits(whole.select("u", "field", "digest").join(copies.select("field", "digest", "rep"), ["field", "digest"]).where("rep <> u").select("u")), "later", free=True)
    likely = candidates(_without(whole.select("u", "field", "anchor", "near", "whole", "n"), later), segments, threshold)
    prints = stage(whole.select("u", "field", "id", "digest", "wide", "n"), "prints")
    drop_staged(whole)
    members = prints.select("u", "field", "id", "digest").join(copies.select("field", "digest", "rep"), ["field", "digest"], "left").select("u", "field", "id", F.coalesce("rep", "u").alias("rep"))
    wa, wb = (prints.select(*(F.col(c).alias(f"{c}_{side}") for c in ("u", "n", "wide"))) for side in "ab")
    found = stage(likely.join(wa, "u_a").join(wb, "u_b").where(may_reach(threshold)).select("u_a", "u_b"), "likely", free=True)
    drop_staged(likely)
    involved = stage(found.select(F.explode(F.array("u_a", "u_b")).alias("u")).distinct().join(prints.select("u", "field", "id", "digest"), "u"), "involved", free=True)
    texts = present.join(F.broadcast(involved) if is_small(involved) else involved, ["field", "id", "digest"]).select("u", "text")
    sets = stage(texts.mapInPandas(_shingle_stage(shingle), "u long, s array<int>").dropDuplicates(["u"]), "shingles", free=True)
    sa, sb = sets.select(F.col("u").alias("u_a"), F.col("s").alias("s_a")), sets.select(F.col("u").alias("u_b"), F.col("s").alias("s_b"))
    both = found.join(sa, "u_a").join(sb, "u_b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    pairs = (
        both.withColumn("similarity", F.col("common") / (F.size("s_a") + F.size("s_b") - F.col("common")))
        .where(F.col("similarity") >= threshold)
        .select(F.col("u_a").alias("rep_a"), F.col("u_b").alias("rep_b"), "similarity")
    )
    return members, pairs, copies.select("field", "rep", "n")


def near_copy_rows(docs: DataFrame, **options) -> DataFrame:
    """All pairs of rows ``(field, id_a, id_b)`` that are equal or near copies, ``id_a`` < ``id_b``.

    This is the expanded form for consumers that want row pairs: a text that occurs n times makes
    n(n-1)/2 of them. ``near_copies`` itself compares each different text once.
    """
    members, pairs, copies = near_copies(docs, **options)
    pairs = stage(pairs, "pairs", free=True)
    copied = stage(members.join(copies.select("rep"), "rep"), "copied", free=True)
    name = members.select("u", "field", "id")
    ids = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("u")).distinct().join(name, "u")
    own = ids.join(copied.select(F.col("rep").alias("u"), F.col("id").alias("copy")), "u", "left").select("u", "field", F.coalesce("copy", "id").alias("id"))
    left, right = own.select(F.col("u").alias("rep_a"), "field", F.col("id").alias("x")), own.select(F.col("u").alias("rep_b"), F.col("id").alias("y"))
    across = pairs.select("rep_a", "rep_b").join(left, "rep_a").join(right, "rep_b").select("field", "x", "y")
    same = copied.select("rep", "field", F.col("id").alias("x")).join(copied.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("field", "x", "y")
    return across.unionAll(same).select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_copy_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per text: ``field, id, group, links``.

    ``group`` is the least member's id over all texts connected by near copies (exact copies included),
    ``links`` the number of different texts that are near copies of it plus its other exact copies. Texts
    without any are groups of their own.
    """
    from ..operators.components import connected_components

    members, pairs, copies = near_copies(docs, **options)
    pairs = stage(pairs, "pairs", free=True)
    parts = connected_components(pairs, "rep_a", "rep_b")
    degree = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("near"))
    m = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").join(copies.select("rep", "n"), "rep", "left")
    m = stage(m.select("field", "id", F.coalesce("component", "rep").alias("part"), (F.coalesce("near", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links")), "members")
    least = m.groupBy("part").agg(F.min("id").alias("group"))
    return m.join(least, "part").select("field", "id", "group", "links")
