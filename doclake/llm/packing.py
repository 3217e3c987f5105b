"""Vector bin packing of documents into training sequences.

A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and ``max_loss``
loss-bearing tokens. The dot-product heuristic fills it: of the pieces that still fit, the
one goes in whose demand vector has the largest dot product with the room that is left. When
nothing fits whole, a piece is cut to the room. Each task packs the rows of its own scan
partition from a pool of bounded size, so nothing is shuffled, and a task that is run again
packs the same. What is left at the end goes into sequences whose lengths are powers of two.

Defined cases: null and empty texts are one end id; null ids stay null; repeated rows are
packed each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from doclake.llm.common import texts_of
from doclake.llm.tokens import coder, with_end

POOL = 1024
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long, ids array<int>")


@dataclass
class Limits:
    max_tokens: int = 4096
    max_segments: int = 64
    max_loss: int = 4096


@dataclass
class Item:
    """What is left of a document: its ids, the first place left, where loss-bearing tokens begin."""

    doc_id: int | None
    ids: np.ndarray
    loss_from: int
    start: int = 0

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))


class Packer:
    """Packs a stream of documents; ``sequences`` yields lists of (item, start, length)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.items: list[Item] = []
        self.tokens = np.zeros(POOL + 1, np.int64)
        self.loss = np.zeros(POOL + 1, np.int64)

    def add(self, item: Item) -> None:
        i = len(self.items)
        self.items.append(item)
        self._measure(i)

    def _measure(self, i: int) -> None:
        item = self.items[i]
        self.tokens[i] = len(item.ids) - item.start
        self.loss[i] = item.loss(int(self.tokens[i]))

    def _remove(self, i: int) -> None:
        last = self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self._measure(i)

    def waiting(self) -> int:
        return int(self.tokens[: len(self.items)].sum())

    def sequence(self, room: int) -> list[tuple[Item, int, int]]:
        """The next sequence, of at most ``room`` tokens."""
        m = self.limits
        segments, loss, out = m.max_segments, m.max_loss, []
        while room and segments and self.items:
            n = len(self.items)
            tokens, losses = self.tokens[:n], self.loss[:n]
            fits = (tokens <= room) & (losses <= loss)
            score = tokens * (room / m.max_tokens**2) + losses * (loss / m.max_loss**2) + segments / m.max_segments**2
            i = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[i]:
                length = int(tokens[i])
            else:
                i = int(np.argmax(tokens))
                item = self.items[i]
                length = min(room, int(tokens[i]), max(0, item.loss_from - item.start) + loss)
                if not length:
                    break
            item = self.items[i]
            out.append((item, item.start, length))
            room, segments, loss = room - length, segments - 1, loss - item.loss(length)
            item.start += length
            if item.start == len(item.ids):
                self._remove(i)
            else:
                self._measure(i)
        return out

    def drain(self):
        """All that waits, as whole sequences and then by powers of two."""
        while self.items:
            left = self.waiting()
            yield self.sequence(self.limits.max_tokens if left >= self.limits.max_tokens else 1 << (left.bit_length() - 1))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id",
         loss_from: str | None = None, limits: Limits | None = None, ids: bool = True) -> DataFrame:
    """One row per piece, see ``SCHEMA``; ``ids`` keeps the token ids in it.

    ``loss_from`` names a column with the number of leading tokens that bear no loss
    (a prompt); without it all tokens bear loss.
    """
    m = limits or Limits()

    def run(batches):
        from pyspark import TaskContext

        packer, number = Packer(m), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal number
            offset = 0
            for item, start, length in pieces:
                part = item.ids[start : start + length]
                bearing = max(0, start + length - max(start, item.loss_from))
                rows.append((item.doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(item.ids),
                             number, offset, bearing, part if ids else None))
                offset += length
            number += 1

        for b in batches:
            found, bounds = with_end(*coder(vocabulary).encode(texts_of(b.column(1))), end_id)
            for i, (key, free) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                packer.add(Item(key, found[bounds[i] : bounds[i + 1]].copy(), free or 0))  # a view would keep its batch
                while len(packer.items) >= POOL or packer.waiting() >= POOL * m.max_tokens:
                    emit(packer.sequence(m.max_tokens))
                if len(rows) >= 2000:
                    yield _columns(rows)
                    rows.clear()
        for pieces in packer.drain():
            emit(pieces)
        yield _columns(rows)

    free = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    out = docs.select(F.col(doc_id).cast("long"), F.col(text), free).mapInArrow(run, SCHEMA)
    return out if ids else out.drop("ids")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
