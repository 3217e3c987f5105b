"""Benchmark passages inside documents, within an edit distance counted in words.

An item of n words may differ by k = floor(``rate`` * n) words (replaced, missing, extra). Cut
into k + 1 pieces, at least one piece is found exactly wherever the item occurs (pigeonhole),
so documents are scanned for exact pieces only: every run of words as long as a piece is
hashed and looked up. Around each hit Myers' bit-parallel algorithm gives the least distance
of the item to any run of the document's words. Words are compared in lower case and without
punctuation.

The test items are the query set: they are read in blocks of at most ``block_bytes`` of text,
and each block goes to the tasks as one table; documents are never shuffled.

Defined cases: null and empty documents or items (no words) match nothing; repeated rows are
each reported; an empty table gives an empty result. Documents keep all their columns in
:func:`clean`; extra columns are ignored by :func:`matches`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from doclake.llm import words
from doclake.llm.common import ID, ROW, kept_numbers, numbered, packed, runs_of, texts_of, written

SCHEMA = f"{ID} long, doc_id long, item_id long, n_words int, distance int, start_word long, end_word long"
_SIGNS = bytes(b if chr(b).isalnum() or b > 127 or b in b" \t\n\x0b\x0c\r" else 0x20 for b in range(256))
_LATIN_SIGNS = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\xa0-\xbf]")


def plain(text: str) -> bytes:
    """Lower case, with signs and punctuation as spaces."""
    data = text.lower().encode("utf-8", "replace").translate(_SIGNS)
    return _LATIN_SIGNS.sub(b" ", data) if b"\xc2" in data or b"\xe2\x80" in data else data


def distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of the text, and where that run ends (Myers 1999)."""
    m = len(pattern)
    places: dict[int, int] = {}
    for i, p in enumerate(pattern):
        places[p] = places.get(p, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        same = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(flat | up) & full, up & flat
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(same | plus) & full, plus & same
        if score < best[0]:
            best = (score, j)
    return best


class Items:
    """One block of test items: their words and the table of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        h, bounds = words.hashes([plain(t) for _, t in items])
        self.words = [h[bounds[i] : bounds[i + 1]].tolist() for i in range(len(items))]
        self.budget = [int(rate * len(w) + 1e-9) for w in self.words]
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), self.budget[i] + 2).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a:
                    piece = np.array(w[a:b], np.uint64)
                    by_length.setdefault(b - a, []).append((int(words.windows(piece, np.array([0, b - a]), b - a)[0][0]), i, a))
        self.pieces = {}
        for length, found in by_length.items():
            found.sort()
            key, item, at = zip(*found, strict=True)
            self.pieces[length] = np.array(key, np.uint64), np.array(item), np.array(at)

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place of the item's first word) of all exact pieces, in order."""
        out = []
        for length, (keys, item, at) in self.pieces.items():
            value, doc, place = words.windows(h, bounds, length)
            low = np.searchsorted(keys, value)
            near = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == value)
            low, high = low[near], np.searchsorted(keys, value[near], "right")
            many = high - low
            entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            who = np.repeat(doc[near], many)
            out.append(np.stack([who, item[entry], np.repeat(place[near], many) - bounds[who] - at[entry]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of each item a text holds, at its best place."""
        h, bounds = words.hashes([plain(t) for t in texts])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, first, last in _windows(self.hits(h, bounds), self.budget):
            k, w = self.budget[item], self.words[item]
            low, high = max(0, first - k), min(int(bounds[doc + 1] - bounds[doc]), last + len(w) + k)
            run = h[bounds[doc] + low : bounds[doc] + high].tolist()
            d, end = distance(w, run)
            if d <= k and (d, low + end) < best.get((doc, item), (k + 1, 0, 0))[:2]:
                best[doc, item] = d, low + end, max(0, low + end - len(w))
        for (doc, item), (d, end, start) in best.items():
            yield doc, item, d, start, end


def _windows(hits: np.ndarray, budget: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Hits of one item in one text whose windows overlap, as one window (text, item, first, last)."""
    held: list[int] | None = None
    for doc, item, place in hits.tolist():
        if held and held[:2] == [doc, item] and place - held[3] <= 2 * budget[item] + 1:
            held[3] = place
            continue
        if held:
            yield tuple(held)
        held = [doc, item, place, place]
    if held:
        yield tuple(held)


def blocks(benchmark: DataFrame, text: str, item_id: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        if size and size + len(r[1]) > block_bytes:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, text: str = "text", doc_id: str = "doc_id",
            item_text: str = "text", item_id: str = "item_id", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document row and item it holds; see ``SCHEMA``.

    Documents that have a column ``_llm_id`` keep their numbers; else a number holds within
    its block of items only.
    """
    rows = (docs if ID in docs.columns else numbered(docs)).select(ID, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = [_scan(rows, Items(block, rate)) for block in blocks(benchmark, item_text, item_id, block_bytes)]
    return reduce(DataFrame.unionAll, found)


def _scan(rows: DataFrame, items: Items) -> DataFrame:
    def run(batches):
        for b in batches:
            keys, ids, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for begin, texts in runs_of(texts_of(b.column(2))):
                for doc, item, d, start, end in items.matches(texts):
                    out.append((keys[begin + doc], ids[begin + doc], items.ids[item], len(items.words[item]), d, start, end))
            if out:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    kept = kept_numbers(docs)
    bad = written(matches(kept, benchmark, rate, text, doc_id).select(ID).distinct(), "contaminated")
    return packed(kept, docs.columns, ID).join(bad, ID, "left_anti").select(f"{ROW}.*")
