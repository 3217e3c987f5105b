"""WARC archives and a two-level capture index.

Every page becomes one record of a .warc.gz file (one gzip member per record): a response
with the page as payload, or a revisit that names the response with the same payload. Index
lines (reversed-host URL key, place of the record) are sorted over all archives and written as
shards of compressed blocks of ``BLOCK`` lines; a shard ends with its sparse directory, the
first key of each block. A look-up finds the shards by their first keys, binary-searches the
directory, reads the blocks that can hold the key, and reads just the record's bytes.

Defined cases: a null page is an empty payload; a null URL has the key ``-``; null page ids
come after all others when the response of equal payloads is chosen; repeated rows are records
of their own; an empty table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from doclake.llm import store
from doclake.llm.common import ID, kept_numbers, written

ARCHIVE_BYTES = 64 << 20
BLOCK = 1000
DATE = "2024-01-01T00:00:00Z"  # of the records; the pages carry no time of capture
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", re.I)
_END = struct.Struct("<QII")
CAPTURE = "key string, page_id long, row long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: http://a.b.org/x?y -> org,b,a)/x?y"""
    if url is None:
        return "-"
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)
    m = _URL.match(url)
    if not m:
        return f"){url}"
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{','.join(reversed(m[1].lower().split('.')))}{port}){m[3] or '/'}"


# ------------------------------------------------------------------ records


def _headers(kind: str, fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields]).encode() + b"\r\n"


def record(page: dict) -> bytes:
    """One record as a gzip member. ``page``: page_id, row, url, payload, and the response's id if it is a revisit."""
    payload, revisit = page["payload"], page["first_row"] is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    fields = [
        ("WARC-Record-ID", f"<urn:page:{page['page_id']}:{page['row']}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", page["url"] or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{page['first_id']}:{page['first_row']}>")]
    return gzip.compress(_headers("revisit" if revisit else "response", fields) + body + b"\r\n\r\n", 5, mtime=0)


def parse(data: bytes) -> dict:
    """A record's facts: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit)."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda urn: None if urn is None or urn.split(":")[2] == "None" else int(urn.split(":")[2])
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": None if revisit else payload}


# ------------------------------------------------------------------ writing


def write_archives(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write all pages as archives; returns the captures (see ``CAPTURE``). Written."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = kept_numbers(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html")))
    facts = written(rows.select(ID, "page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("size")), "payloads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("first_id"), F.col(ID).alias("first_row"))).alias("first")
    equal = facts.where(F.col("size") >= min_bytes).groupBy("sha1").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = facts.where(F.col("size") >= min_bytes).join(equal, "sha1").where(F.col(ID) != F.col("first.first_row"))
    revisits = written(revisits.select(ID, "first.first_id", "first.first_row"), "revisits")
    folder = store.new_folder(pages.sparkSession, "warc")

    def run(batches):
        stream, place = None, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if stream is None:
                    path, stream = store.open_new(folder, ".warc.gz")
                    info = b"software: doclake\r\nformat: WARC File Format 1.1\r\n"
                    head = _headers("warcinfo", [("WARC-Record-ID", f"<urn:archive:{path.rsplit('/', 1)[1]}>"), ("WARC-Date", DATE),
                                                 ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))])
                    data = gzip.compress(head + info + b"\r\n\r\n", mtime=0)
                    stream.write(data)
                    place = len(data)
                data = record({"page_id": r["page_id"], "row": r[ID], "url": r["url"], "payload": r["html"].encode("utf-8", "replace"),
                               "first_id": r["first_id"], "first_row": r["first_row"]})
                stream.write(data)
                out.append((url_key(r["url"]), r["page_id"], r[ID], path, place, len(data)))
                place += len(data)
                if place >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            yield _captures(out)
        if stream is not None:
            stream.close()

    return written(rows.join(revisits, ID, "left").mapInArrow(run, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CAPTURE.split(", ")])


def _footer(place: int, size: int, blocks: int) -> bytes:
    return _END.pack(place, size, blocks)


def write_index(captures: DataFrame) -> DataFrame:
    """Sort the captures into shards of compressed blocks; one row per shard: path, first_key, lines. Written."""
    spark = captures.sparkSession
    folder, n = store.new_folder(spark, "capture-index"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        stream, held, directory, place, lines = None, [], [], 0, 0

        def flush():
            nonlocal place, held
            data = gzip.compress("\n".join(held).encode(), 5, mtime=0)
            directory.append(f"{held[0].partition(' ')[0]} {place} {len(data)}")
            stream.write(data)
            place, held = place + len(data), []

        for b in batches:
            for r in b.to_pylist():
                if stream is None:
                    path, stream = store.open_new(folder, ".idx")
                    first = r["key"]
                held.append(f"{r['key']} {'' if r['page_id'] is None else r['page_id']} {r['row']} {r['offset']} {r['length']} {r['archive']}")
                lines += 1
                if len(held) == BLOCK:
                    flush()
        if stream is not None:
            if held:
                flush()
            data = gzip.compress("\n".join(directory).encode(), 5, mtime=0)
            stream.write(data + _footer(place, len(data), len(directory)))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_key": first, "lines": lines}])

    order = ["key", "page_id", "row"]
    rows = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(run, "path string, first_key string, lines long"), "index-shards")


# ------------------------------------------------------------------ reading


class Shard:
    """One shard opened for look-ups; keeps its directory and the last block."""

    def __init__(self, path: str):
        self.source = store.open_old(path)
        end = self.source.size()
        self.source.seek(end - _END.size)
        place, size, _ = _END.unpack(self.source.read(_END.size))
        self.blocks = [line.split(" ") for line in self._read(place, size)]
        self.first = [b[0] for b in self.blocks]
        self.held: tuple[int, list[str]] = (-1, [])

    def _read(self, place: int, size: int) -> list[str]:
        self.source.seek(place)
        return gzip.decompress(self.source.read(size)).decode().split("\n")

    def find(self, key: str) -> Iterator[tuple]:
        """All captures of a key: the block before the first that starts with or after it, and those that start with it."""
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.blocks) and self.first[i] <= key:
            if self.held[0] != i:
                self.held = i, self._read(int(self.blocks[i][1]), int(self.blocks[i][2]))
            lines = self.held[1]
            for j in range(bisect.bisect_left(lines, key + " "), len(lines)):
                found, page_id, row, offset, length, archive = lines[j].split(" ", 5)
                if found != key:
                    break
                yield key, int(page_id) if page_id else None, int(row), archive, int(offset), int(length)
            i += 1


def locate(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures of the keys (column ``key``, distinct), see ``CAPTURE``."""
    known = sorted((r["first_key"], r["path"]) for r in shards.collect())  # one row per shard
    firsts, paths = [k for k, _ in known], [p for _, p in known]

    def assign(batches):
        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                low = max(0, bisect.bisect_left(firsts, key) - 1)
                out += [(key, i) for i in range(low, bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([i for _, i in out], pa.int64())], ["key", "shard"])

    def search(batches):
        at, shard = -1, None
        for b in batches:
            out = []
            for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != at:
                    at, shard = i, Shard(paths[i])
                for row in shard.find(key):
                    out.append(row)
                    if len(out) == 5000:
                        yield _captures(out)
                        out = []
            yield _captures(out)

    wanted = keys.where(F.col("key").isNotNull()).select("key").mapInArrow(assign, "key string, shard long")
    return wanted.repartition(max(1, len(paths)), "shard").sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """The records of captures by range reads, archive by archive in order of place."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        at, source = "", None
        for b in batches:
            out = []
            for archive, offset, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if archive != at:
                    if source is not None:
                        source.close()
                    at, source = archive, store.open_old(archive)
                source.seek(offset)
                found = parse(source.read(length))
                out.append([found[n] for n in names])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    rows = captures.select("archive", "offset", "length")
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "archive").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def url_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct keys of URLs."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])

    return urls.select(F.col(url).cast("string")).mapInArrow(run, "key string").distinct()


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archive all pages, index them, and read every page's record back by its URL."""
    shards = write_index(write_archives(pages))
    return read_records(locate(shards, url_keys(pages)))
