"""Pages of a large table by their number, without sorting the table for every page.

A rank directory holds the keys of a table in ranges of about ``rows_per_range`` rows, one folder per
range, and the number of rows of each range. A page number gives a row number, the counts give the
range it lies in, and the keys of that range give the page's keys; the rows of these keys are then
read from the table, of which a filter on its bucket column prunes all other buckets.

The directory is built by one shuffle of the keys. Later it reads only files that the table has
got since; it is built anew when files are gone, or when appends have piled up.
"""

from __future__ import annotations

import json
import uuid
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doclake.session import exists, read_text, write_text

MAX_RANGES = 1 << 16  # their lowest keys and counts reach the driver
MAX_SEGMENTS = 16
GROWTH = 4  # the ranges are drawn anew when there are so many times the rows they were drawn for
MAX_NAMED = 1000  # keys of a page that are named one by one


class RankDirectory:
    """The directory of one table by one key column. Rows without a key come first, as in an ascending order."""

    def __init__(self, spark: SparkSession, folder: str, key: str, rows_per_range: int = 10_000):
        self.spark, self.folder, self.key, self.rows_per_range = spark, folder.rstrip("/"), key, rows_per_range

    # ------------------------------------------------------------------------ building

    def refresh(self, table: DataFrame) -> "RankDirectory":
        """Bring the directory up to the files of the table, which is a frame that reads files."""
        kept, files = self._kept(), sorted(table.inputFiles())
        known = set(self._sources(kept)) if kept else set()
        if kept and known == set(files):
            return self
        rows = self.rows()
        if not rows or known - set(files) or len(kept["segments"]) >= MAX_SEGMENTS or rows > GROWTH * kept["built"]:
            return self._build(table, files)
        new = [unquote(f) for f in files if f not in known]
        keys = self.spark.read.schema(table.select(self.key).schema).parquet(*new)
        self._add(keys.withColumn("range", self._range_of(F.col(self.key), kept)).repartition("range"), kept, files)
        return self

    def _build(self, table: DataFrame, files: list[str]) -> "RankDirectory":
        keys = table.select(self.key)
        rows = keys.count()
        ranges = max(1, min(MAX_RANGES, -(-rows // self.rows_per_range)))
        # A task is a range. Equal keys are in one, however many there are.
        dealt = keys.repartitionByRange(ranges, self.key).withColumn("range", F.spark_partition_id())
        self._add(dealt, {"segments": [], "version": (self._kept() or {"version": 0})["version"], "built": max(rows, self.rows_per_range)}, files)
        return self

    def _add(self, keys: DataFrame, kept: dict, files: list[str]) -> None:
        """Write a segment of keys, of which each range lies in one task, the counts with it, and last the file that names them all."""
        segment, counts, sources = (f"{kind}-{uuid.uuid4().hex}" for kind in ("keys", "counts", "sources"))
        keys.sortWithinPartitions("range", self.key).write.partitionBy("range").parquet(f"{self.folder}/{segment}")
        added = self._segment(segment, keys.schema[self.key].dataType.simpleString()).groupBy("range").agg(
            F.min(self.key).alias("low"), F.count("*").alias("rows"))
        if kept["segments"]:
            # A range keeps its lowest key: that is what rows are assigned by.
            old = self.spark.read.parquet(f"{self.folder}/{kept['counts']}")
            added = old.join(added.select("range", F.col("rows").alias("more")), "range", "full").select(
                "range", "low", (F.coalesce("rows", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("rows"))
        added.coalesce(1).write.parquet(f"{self.folder}/{counts}")
        self.spark.createDataFrame([(f,) for f in files], "file string").write.parquet(f"{self.folder}/{sources}")
        state = {"version": kept["version"] + 1, "built": kept["built"], "type": keys.schema[self.key].dataType.simpleString(),
                 "segments": [*kept["segments"], segment], "counts": counts, "sources": sources}
        write_text(self.spark, f"{self.folder}/directory.json", json.dumps(state))

    def _kept(self) -> dict | None:
        text = read_text(self.spark, f"{self.folder}/directory.json")
        return json.loads(text) if text else None

    def _sources(self, kept: dict) -> list[str]:
        return [r["file"] for r in self.spark.read.parquet(f"{self.folder}/{kept['sources']}").collect()]

    def _segment(self, segment: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"`{self.key}` {kind}, range int").parquet(f"{self.folder}/{segment}")

    def _counts(self, kept: dict) -> list:
        return self.spark.read.parquet(f"{self.folder}/{kept['counts']}").orderBy("range").collect()

    def _range_of(self, key: Column, kept: dict) -> Column:
        """The range of a key: a binary search in the lowest keys of all ranges but the first."""
        counts = self._counts(kept)
        numbers = F.from_json(F.lit(json.dumps([r["range"] for r in counts])), "array<int>")
        lows = F.from_json(F.lit(json.dumps([None if r["low"] is None else str(r["low"]) for r in counts])), "array<string>").cast(f"array<{kept['type']}>")
        steps = [1 << b for b in reversed(range(len(counts).bit_length()))]

        def further(at: Column, step: Column) -> Column:
            reached = (at + step < len(counts)) & (F.get(lows, at + step) <= key)
            return F.when(reached, at + step).otherwise(at)

        return F.get(numbers, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further))

    # ------------------------------------------------------------------------- reading

    def rows(self) -> int:
        kept = self._kept()
        return sum(r["rows"] for r in self._counts(kept)) if kept else 0

    def page_count(self, size: int = 10) -> DataFrame:
        rows = self.rows()
        return self.spark.createDataFrame([(rows, -(-rows // size))], "row_count long, total_pages long")

    def page_keys(self, page: int, size: int) -> tuple[list, int]:
        """The keys of a page in order, and how many rows with its first key come before it."""
        kept = self._kept()
        if not kept or not kept["segments"]:
            return [], 0
        counts = self._counts(kept)
        ends = list(accumulate(r["rows"] for r in counts))
        first = page * size
        # From the range that holds the page's first row to the one that holds its last.
        held = [i for i, r in enumerate(counts) if ends[i] > first and ends[i] - r["rows"] < first + size]
        if not held or size <= 0:
            return [], 0
        before = first - (ends[held[0]] - counts[held[0]]["rows"])
        folders = [f"{self.folder}/{s}/range={counts[i]['range']}" for s in kept["segments"] for i in held]
        folders = [f for f in folders if exists(self.spark, f)]
        keys = self.spark.read.schema(f"`{self.key}` {kept['type']}").parquet(*folders)
        found = [r[0] for r in keys.orderBy(self.key).offset(before).limit(size).collect()]
        earlier = keys.where(F.col(self.key) < F.lit(found[0])).count() if found[0] is not None else 0
        nulls = keys.where(F.col(self.key).isNull()).count() if found[0] is not None else 0
        return found, before - earlier - nulls

    def page(self, table: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
        """The rows of a page, of as many columns as the table has. :meth:`refresh` comes first where it may have grown."""
        keys, skipped = self.page_keys(page, size)
        if not keys:
            return table.limit(0)
        key, named = F.col(self.key), [k for k in dict.fromkeys(keys) if k is not None]
        wanted = F.lit(False)
        if named:
            wanted = key.isin(named) if len(named) <= MAX_NAMED else key.between(F.lit(named[0]), F.lit(named[-1]))
        if None in keys:
            wanted = wanted | key.isNull()
        return table.where(wanted).orderBy(self.key).offset(skipped).limit(size)
