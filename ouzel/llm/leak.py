"""Evaluation passages in a corpus, by Wu-Manber search over words.

The alphabet is words as a reader sees them; every run of ``length`` words of a protected passage is a
pattern. A block is two words. The shift table tells for each block how far the search may move on; a
block that ends a pattern has shift 0 and selects, by its hash, the patterns with that suffix, which are
then compared word by word. All documents of a batch move in step, so that the search runs in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..session import stage
from .lookalike import consistent_form
from .words import mix, pieces, word_hashes

BLOCK = 2
#: Places that one strand of the search passes, in words.
LANE = 2048
_K = np.uint64(0x9E3779B97F4A7C15)
#: Combining marks that no composed letter holds.
_MARKS = re.compile("[\u0300-\u036f]")


def _blocks(flat: np.ndarray) -> np.ndarray:
    """At each place the hash of the block that ends there (the first place's is meaningless)."""
    return mix(np.concatenate([np.zeros(1, np.uint64), flat[:-1]]) * _K + flat) if len(flat) else flat


@dataclass
class Patterns:
    words: np.ndarray  # patterns x length
    item: np.ndarray
    blocks: np.ndarray  # sorted block hashes
    shift: np.ndarray  # of each block
    suffix: np.ndarray  # sorted block hashes at patterns' ends
    start: np.ndarray  # of each suffix in order
    order: np.ndarray  # patterns by suffix
    length: int

    @classmethod
    def build(cls, items: list[int], texts: list[str], length: int) -> Patterns:
        flat, sizes = word_hashes([_MARKS.sub("", t) for t in texts])
        rows, owner, at = [], [], 0
        for item, n in zip(items, sizes.tolist()):
            for k in range(at, at + n - length + 1):
                rows.append(flat[k : k + length])
                owner.append(item)
            at += n
        if not rows:
            none = np.zeros(0, np.uint64)
            return cls(np.zeros((0, length), np.uint64), np.zeros(0, np.int64), none, none.astype(np.int64), none, np.zeros(1, np.int64), none.astype(np.int64), length)
        words, item = np.array(rows), np.array(owner)
        _, first = np.unique(np.column_stack([words, item.astype(np.uint64)]), axis=0, return_index=True)
        words, item = words[first], item[first]
        every = mix(words[:, :-1] * _K + words[:, 1:])  # block j ends at word j + 1
        distance = np.broadcast_to(np.arange(length - BLOCK, -1, -1), every.shape)
        by = np.lexsort((distance.ravel(), every.ravel()))
        blocks, at_first = np.unique(every.ravel()[by], return_index=True)
        order = np.argsort(every[:, -1], kind="stable")
        suffix, start = np.unique(every[order, -1], return_index=True)
        return cls(words, item, blocks, distance.ravel()[by][at_first], suffix, np.append(start, len(order)), order, length)

    def search(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and items of all occurrences (with repeats)."""
        none = np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        text = np.nonzero(sizes >= self.length)[0]
        if not len(text) or not len(self.words):
            return none, none
        block = _blocks(flat)
        at, end = ends[text] - sizes[text] + self.length - 1, ends[text]
        lanes = -(-(end - at) // LANE)  # long texts are searched in several places at once
        which = np.repeat(np.arange(len(text)), lanes)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        text, at = text[which], at[which] + nth * LANE
        end = np.minimum(at + LANE, end[which])
        found_text, found_item = [], []
        while len(text):
            h = block[at]
            k = np.minimum(np.searchsorted(self.blocks, h), len(self.blocks) - 1)
            step = np.where(self.blocks[k] == h, self.shift[k], self.length - BLOCK + 1)
            stop = np.nonzero(step == 0)[0]
            if len(stop):
                s = np.searchsorted(self.suffix, h[stop])
                sizes_ = self.start[s + 1] - self.start[s]
                which = np.repeat(np.arange(len(stop)), sizes_)
                inner = np.arange(sizes_.sum()) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
                pattern = self.order[self.start[s][which] + inner]
                place = at[stop][which]
                ok = np.ones(len(pattern), bool)
                for j in range(self.length):  # direct comparison, ending with the first word
                    alive = np.nonzero(ok)[0]
                    ok[alive] = flat[place[alive] - j] == self.words[pattern[alive], self.length - 1 - j]
                found_text.append(text[stop][which[ok]])
                found_item.append(self.item[pattern[ok]])
            at = at + np.maximum(step, 1)
            go = at < end
            text, at, end = text[go], at[go], end[go]
        return (np.concatenate(found_text), np.concatenate(found_item)) if found_text else (none, none)


def _search_stage(patterns):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, names = patterns.value
        for b in pieces(batches, "form"):
            flat, sizes = word_hashes([_MARKS.sub("", t) for t in b["form"].tolist()])
            text, item = p.search(flat, sizes)
            hits = pd.DataFrame({"row": text, "item": item}).groupby(["row", "item"]).size().reset_index(name="windows")
            yield pd.DataFrame({"doc_id": b["doc_id"].take(hits["row"]).reset_index(drop=True), "item_id": names.take(hits["item"]).reset_index(drop=True), "windows": hits["windows"]})

    return run


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passages: list[str], length: int = 12, block_chars: int = 4 << 20) -> DataFrame:
    """``(doc_id, item_id, windows)``: documents that hold ``length`` consecutive words of an item.

    ``windows`` counts occurrences of such runs. Words are compared in lower case after
    ``consistent_form``. The protected passages are sent out in blocks of at most ``block_chars``
    characters, each searched by a pass of its own, so what is sent has a bound however many items there
    are; if there are several, forms of the corpus are staged once and each pass's findings too. Ids may be of any
    type. Null and short texts and passages and empty tables give no rows; a repeated document id counts as one
    document, with the windows of all its rows. Texts are searched whole.
    """
    spark: SparkSession = docs.sparkSession
    own = items.select(F.col(item_id).alias("item"), F.explode(F.array(*passages)).alias("passage")).where("passage is not null")
    corpus = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = [d.schema[0].dataType for d in (corpus, own)]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, windows long"
    forms = consistent_form(corpus, "text", ["doc_id"])
    blocks = _in_blocks(consistent_form(own, "passage", ["item"]).toLocalIterator(), block_chars)
    block, found = next(blocks, None), []
    while block is not None:
        after = next(blocks, None)
        if after is not None and not found:
            forms = stage(forms, "forms")
        ids, texts = block
        at = {x: i for i, x in enumerate(dict.fromkeys(ids))}
        patterns = spark.sparkContext.broadcast((Patterns.build([at[x] for x in ids], texts, length), pd.Series(list(at), dtype=object)))
        part = forms.mapInPandas(_search_stage(patterns), schema).groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"))
        found.append(stage(part, "leaks") if found or after is not None else part)
        block = after
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows")) if len(found) > 1 else found[0]


def _in_blocks(rows, most: int):
    ids, texts, size = [], [], 0
    for r in rows:
        if size and size + len(r[1]) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if ids:
        yield ids, texts
