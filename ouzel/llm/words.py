"""Words and their hashes, flat over a batch of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

WORD = re.compile(r"[^\W_]+")
_SHIFT = np.uint64(0x9E3779B97F4A7C15)


def refuse_clash(keep: list[str], reserved: tuple[str, ...]) -> None:
    """Raise ``ValueError`` if a column to keep has the name of one that the operator adds."""
    if clash := {k.lower() for k in keep} & {r.lower() for r in reserved}:
        raise ValueError(f"rename the columns {sorted(clash)}")


def pieces(batches: Iterator[pd.DataFrame], column: str, most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Batches cut so that no piece has more than ``most`` characters in ``column``, but for single longer texts.

    Flat arrays take a few hundred bytes a character; this bounds what a task holds however long texts are.
    """
    for b in batches:
        if not len(b):
            continue
        upto = np.cumsum(b[column].str.len().fillna(0).to_numpy(np.int64))
        start, before = 0, 0
        while start < len(b):
            end = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
            yield b.iloc[start:end].reset_index(drop=True)
            before, start = int(upto[end - 1]), end


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in one array, and the words in each text."""
    per_text = [WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
    codes, uniques = pd.factorize(np.array([w for ws in per_text for w in ws], dtype=object))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in uniques), np.uint64, len(uniques))
    return (hashed[codes] if len(codes) else np.zeros(0, np.uint64)), sizes


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(flat: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text, flat, and their number per text."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    out = flat.copy()
    for k in range(1, n):
        nxt = np.roll(flat, -k)
        out = mix(out * _SHIFT + nxt)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))  # words from here to the end of the text
    counts = np.maximum(sizes - n + 1, 0)
    return mix(out[left >= n]), counts
