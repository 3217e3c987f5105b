"""Token ids as canonical, length-limited Huffman codes in files.

Counts of all ids are taken over the whole corpus; package-merge gives code lengths of at
most ``MAX_BITS``; canonical codes follow from the lengths alone, so a file stores only those.
A file holds independent blocks of ``BLOCK`` ids. Within a block the bit offset of every
``STEP``-th id is a checkpoint; decoding starts at all checkpoints at once and takes one
id per checkpoint and table look-up.

File: magic, vocabulary size, code lengths (one byte per id); blocks of (ids, checkpoints,
words as 32-bit numbers), each with its length in front; the index of documents (id present,
id, ids in it); at the end the place of the index and magic. All numbers are little-endian.

Defined cases: null and empty texts are one end id; null ids come first; repeated rows are
each written; an empty table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from doclake.llm import store
from doclake.llm.common import ID, numbered, texts_of, written
from doclake.llm.tokens import coder, with_end

MAX_BITS = 18
BLOCK = 1 << 16
STEP = 256
MAGIC = b"HIDS0001"
_END = struct.Struct("<Q8s")


# ------------------------------------------------------------------ the code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit in codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64) if counts.max() > 2**53 else counts[used].astype(np.int64)
    # Each level is the sorted merge of the coins and the packages (pairs) of the level below.
    levels, packages = [], coins[:0]
    for _ in range(max_bits):
        merged = np.concatenate([coins, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order)
        merged = merged[order]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    # The cheapest 2n-2 items of the last level; each chosen package chooses its pair one level below.
    lengths, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for order in reversed(levels):
        chosen = order[:take]
        lengths[chosen[chosen < len(used)]] += 1
        take = 2 * int((chosen >= len(used)).sum())
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sized = lengths[order].astype(np.int64)
    top = int(sized.max()) if len(sized) else 0
    # As numbers of ``top`` bits, codes are running sums of 2**(top - length).
    step = np.int64(1) << (top - sized)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (np.cumsum(step) - step) >> (top - sized)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for every run of ``bits`` bits."""
    codes, bits = canonical_codes(lengths), int(lengths.max(initial=1))
    order = np.flatnonzero(lengths)
    order = order[np.argsort(codes[order].astype(np.int64) << (bits - lengths[order].astype(np.int64)))]
    repeat = np.int64(1) << (bits - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << bits, np.int32), np.ones(1 << bits, np.uint8)
    n = int(repeat.sum())
    ids[:n], size[:n] = np.repeat(order, repeat), np.repeat(lengths[order], repeat)
    return ids, size, bits


# ------------------------------------------------------------------ blocks


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size)
    at = end - size
    word = (at >> np.uint64(5)).astype(np.int64)
    # A code as the top bits of 64, shifted to its place in its first word; what spills is the next word's.
    placed = codes[ids].astype(np.uint64) << (np.uint64(64) - size - (at & np.uint64(31)))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    total = np.zeros(int(word[-1]) + 2, np.uint64)
    total[word[first]] = np.add.reduceat(placed >> np.uint64(32), first)
    total[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    marks = at[::STEP].astype("<u4")
    body = total.astype("<u4")
    return struct.pack("<III", len(ids), len(marks), len(body)) + marks.tobytes() + body.tobytes()


def decode_block(data: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    ids, size, bits = table
    n, n_marks, n_words = struct.unpack_from("<III", data)
    at = np.frombuffer(data, "<u4", n_marks, 12).astype(np.int64)
    body = np.frombuffer(data, "<u4", n_words, 12 + 4 * n_marks).astype(np.uint64)
    wide = (body << np.uint64(32)) | np.append(body[1:], np.uint64(0))
    last = len(wide) - 1
    out = np.empty((STEP, n_marks), np.int32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(STEP):
        run = (wide[np.minimum(at >> 5, last)] >> (np.uint64(64 - bits) - (at & 31).astype(np.uint64))) & mask
        out[k] = ids[run]
        at += size[run]
    return out.T.reshape(-1)[:n]


# ------------------------------------------------------------------ files


class Writer:
    """One file, block by block."""

    def __init__(self, stream, lengths: np.ndarray):
        self.stream, self.lengths, self.codes = stream, lengths, canonical_codes(lengths)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[tuple[int | None, int]] = []
        self.place = 0
        self._write(MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes())

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            whole = np.concatenate(self.held)
            cut = len(whole) // BLOCK * BLOCK
            for i in range(0, cut, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.codes, self.lengths)
        self._write(struct.pack("<I", len(data)) + data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self._write(struct.pack("<I", 0))
        place = self.place
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        sizes = np.array([n for _, n in self.docs], "<u8")
        self._write(struct.pack("<Q", len(self.docs)) + known.tobytes() + ids.tobytes() + sizes.tobytes())
        self._write(_END.pack(place, MAGIC))
        self.stream.close()


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file: id, token ids. Holds one block and one document at a time."""
    end = source.size()
    source.seek(end - _END.size)
    place, magic = _END.unpack(source.read(_END.size))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    source.seek(place)
    index = source.read(end - _END.size - place)
    n = struct.unpack_from("<Q", index)[0]
    known = np.frombuffer(index, np.uint8, n, 8)
    doc_ids = np.frombuffer(index, "<i8", n, 8 + n)
    sizes = np.frombuffer(index, "<u8", n, 8 + 9 * n)
    source.seek(len(MAGIC))
    vocabulary = struct.unpack("<I", source.read(4))[0]
    table = decode_table(np.frombuffer(source.read(vocabulary), np.uint8))
    block, at = np.zeros(0, np.int32), 0
    for ok, doc_id, size in zip(known, doc_ids, sizes, strict=True):
        parts, missing = [], int(size)
        while missing:
            if at == len(block):
                block, at = decode_block(source.read(struct.unpack("<I", source.read(4))[0]), table), 0
            parts.append(block[at : at + missing])
            at += len(parts[-1])
            missing -= len(parts[-1])
        yield (int(doc_id) if ok else None), np.concatenate(parts) if parts else block[:0]


# ------------------------------------------------------------------ Spark jobs


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: _llm_id, doc_id, and its ids as packed bytes; written once."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, bounds = with_end(*coder(vocabulary).encode(texts_of(b.column(2))), end_id)
            blobs = [pack.compress(_narrow(ids[bounds[i] : bounds[i + 1]])) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], [ID, "doc_id", "ids"])

    rows = numbered(docs).select(ID, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"{ID} long, doc_id long, ids binary"), "token-ids")


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes per id where that is enough, marked by the first byte."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x02" else "<u4", offset=1)


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; one row per id of the vocabulary reaches the driver."""

    def run(batches):
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(size, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.bincount(_wide(unpack.decompress(blob)), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_files(tokens: DataFrame, lengths: np.ndarray, folder: str) -> DataFrame:
    """Files in ascending order of document ids; one row per file: part, path, n_docs, n_tokens."""
    spark = tokens.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        unpack, writer, path = zstandard.ZstdDecompressor(), None, ""
        for b in batches:
            for doc_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if writer is None:
                    path, stream = store.open_new(folder, ".hid")
                    writer = Writer(stream, lengths)
                writer.add(doc_id, _wide(unpack.decompress(blob)))
        if writer is not None:
            writer.close()
            row = (TaskContext.get().partitionId(), path, len(writer.docs), writer.n_ids)
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "n_docs", "n_tokens"), row, strict=True))])

    ordered = tokens.repartitionByRange(n, "doc_id", ID).sortWithinPartitions("doc_id", ID)
    return written(ordered.select("doc_id", "ids").mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "id-files")


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    bases, total = [], 0
    for r in files.orderBy("part").collect():  # one row per file
        bases.append((r["part"], r["path"], total))
        total += r["n_tokens"]

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows, start = [], base
                with store.open_old(path) as source:
                    for doc_id, ids in read_file(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _columns(rows)
                            rows = []
                yield _columns(rows)

    paths = spark.createDataFrame(bases, "part long, path string, base long")
    return paths.repartitionByRange(max(1, len(bases)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all documents as Huffman-coded files; returns the table of files."""
    tokens = tokenized(docs, vocabulary, end_id, text, doc_id)
    counts = id_counts(tokens, max(coder(vocabulary).vocabulary, end_id + 1))
    return write_files(tokens, code_lengths(counts), store.new_folder(docs.sparkSession, "huffman"))
