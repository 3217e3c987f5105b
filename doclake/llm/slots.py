"""Sharding by fixed virtual slots.

A record's hash names one of ``slots`` virtual slots, for good. Bytes are summed by slot, and
a versioned map gives each slot a shard: version 1 places the heaviest slots first, each on
the lightest shard. :func:`rebalance` makes the next version for another number of shards by
moving as few slots as it needs; records in other slots stay where they are. The map has one
row per slot, so its size is a parameter; it is built on the driver and stored as a table.

A record's place in its shard is gapless: rows are counted by (slot, scan partition), never
in one group per shard, and the counts before a row's group are added to its number there.

Defined cases: a null text has no bytes; null ids hash as null, with the text's checksum;
repeated rows share a slot and get places of their own; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from doclake.llm.common import written

EXTRA = 16  # bytes per record beside its text
MAP_SCHEMA = "version int, slot int, bytes long, shard int"


def balanced(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot -> shard, heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards: slots of shards that are gone, and slots above a
    shard's even share, move to the lightest shard; all others stay."""
    share = sum(sizes.values()) / shards
    load = dict.fromkeys(range(shards), 0)
    new, moving = {}, []
    for slot in sorted(old, key=lambda s: (sizes.get(s, 0), s)):
        shard, size = old[slot], sizes.get(slot, 0)
        if shard < shards and load[shard] + size <= share:
            new[slot] = shard
            load[shard] += size
        else:
            moving.append(slot)
    for slot in sorted(moving, key=lambda s: (-sizes.get(s, 0), s)):
        shard = min(load, key=lambda s: (load[s], s))
        new[slot] = shard
        load[shard] += sizes.get(slot, 0)
    return new


def map_table(spark: SparkSession, version: int, sizes: dict[int, int], shards: dict[int, int]) -> DataFrame:
    """One version of the map as rows, ready to be appended to a table of versions."""
    rows = [(version, s, sizes.get(s, 0), shards[s]) for s in sorted(shards)]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def records(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slots: int = 4096) -> DataFrame:
    """The narrow facts of each record, written once: id, size, checksum, virtual slot, scan partition."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + EXTRA).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"),
    )
    return written(narrow.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")), "records")


def slot_sizes(found: DataFrame) -> dict[int, int]:
    return {r["vslot"]: r["bytes"] for r in found.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def shard(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", slots: int = 4096) -> DataFrame:
    """Per record: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard, vslot."""
    spark = docs.sparkSession
    found = records(docs, text, doc_id, slots)
    sizes = slot_sizes(found)
    slot_map = written(map_table(spark, 1, sizes, balanced(sizes, shards)), "slot-map")

    # Rows before each (slot, partition) group: first within the slot, then over the slots of a shard.
    groups = found.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = written(groups.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))), "slot-groups")
    per_slot = groups.groupBy("vslot").agg(F.sum("n").alias("rows"))
    along = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.join(per_slot, F.col("slot") == F.col("vslot")).select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("first"))
    starts = groups.join(placed, "vslot").select("vslot", "part", "shard", (F.col("first") + F.col("before")).alias("base"))

    own = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    rows = found.withColumn("rank", F.row_number().over(own) - 1)
    return rows.join(written(starts, "slot-starts"), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
