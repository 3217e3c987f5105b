"""Near duplicates by weighted Jaccard similarity of word shingles, with BagMinHash signatures.

A text is a bag of five-word shingles with their counts. Every shingle owns Poisson processes
of points in time, one for each dyadic range of weights (0,1], (1,2], (2,4], ... with the
range's length as rate; inside a range a point belongs to one unit of weight, and it counts
for a bag whose weight reaches that unit. Each point falls into one of ``SIZE`` registers;
a register keeps the earliest point. Two bags agree in a register with probability equal to
their weighted Jaccard similarity. Points later than the last register's minimum cannot
matter, so only the early part of each process is generated.

Texts with the same words are one node. Nodes that agree in a band of registers share a
bucket. Within a bucket all nodes are compared with the one that has most bucket mates. Nodes
of a bucket that are still in different classes are searched by an exact prefix filter, so no
link between members of a bucket is lost. All comparisons are exact overlaps of the bags. Classes are the connected components of
the links.

Defined cases: a text of one to four words is one shingle; null texts and texts without words
resemble nothing, each is its own class in :func:`classes`, while :func:`keep_one` takes them for
equal and keeps one; null ids count as the last of a class; repeated rows
are copies of each other; an empty table gives an empty result. Extra columns are ignored by
:func:`classes` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from doclake.llm import words
from doclake.llm.common import ID, ROW, kept_numbers, packed, runs_of, texts_of, written
from doclake.session import discard

BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
BROADCAST_ROWS = 1_000_000  # node numbers, 8 bytes each
_STEP = np.uint64(0xD1342543DE82EF95)
_WRAP = (1 << 64) - 1


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, text and weight of every element of every bag; hashes and bounds of the words."""
    h, bounds = words.hashes([t.lower().encode("utf-8", "replace") for t in texts])
    value, doc = words.shingles(h, bounds)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])) if len(value) else np.zeros(0, np.int64)
    return value[new], doc[new], np.diff(np.append(new, len(value))), h, bounds


def signatures(value: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """Registers of each bag (times of the earliest points); infinite for an empty bag."""
    out = np.full(n_docs * size, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # One process per element and range of weights.
    ranges = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    which = np.repeat(np.arange(len(value)), ranges)
    level = np.arange(len(which)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    reach = weight[which] - low
    seed = words.mix(value[which] + words.mix(level.astype(np.uint64) + np.uint64(1)))
    owner = doc[which]
    # All registers are filled by this time but for one bag in four hundred; for those it is doubled.
    until = np.where(total > 0, size * (np.log(size) + 6) / np.maximum(total, 1), 0)
    open_docs = total > 0
    while open_docs.any():
        rows = np.flatnonzero(open_docs[owner])
        _points(out, seed[rows], owner[rows], length[rows], reach[rows], until[owner[rows]], size)
        open_docs &= np.isinf(out.reshape(n_docs, size)).any(1)
        until *= 2
    return out.reshape(n_docs, size)


def _points(out, seed, owner, length, reach, until, size) -> None:
    time = np.zeros(len(seed))
    j = 0
    while True:
        j += 1
        draw = words.mix(seed + np.uint64(j * int(_STEP) & _WRAP))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / length
        alive = np.flatnonzero(time <= until)
        if not len(alive):
            return
        seed, owner, length, reach, until, time = (x[alive] for x in (seed, owner, length, reach, until, time))
        place = words.mix(draw[alive] ^ _STEP)
        register = (place % np.uint64(size)).astype(np.int64)
        unit = ((place >> np.uint64(40)).astype(np.float64) * 2.0**-24 * length).astype(np.int64)
        counts = unit < reach
        np.minimum.at(out, owner[counts] * size + register[counts], time[counts])


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = registers.view(np.uint64).reshape(-1, BANDS, ROWS)
    factor = words.mix(np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(7)).reshape(BANDS, ROWS) | np.uint64(1)
    return words.mix((words.mix(bits) * factor).sum(2, dtype=np.uint64)).view(np.int64)


def _name(text: str) -> bytes:
    """A digest of the words of a text, in which texts of equal words agree."""
    return hashlib.blake2b(b" ".join(text.lower().encode("utf-8", "replace").split()), digest_size=16).digest()


def signed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Per row of a numbered table: _llm_id, doc_id, key (a digest of its words, null without words), bands; written once."""

    def run(batches):
        for b in batches:
            for begin, texts in runs_of(texts_of(b.column(2))):
                value, doc, weight, _, bounds = bags(texts)
                keys = band_keys(signatures(value, doc, weight, len(texts)))
                names = [_name(t) if bounds[i + 1] > bounds[i] else None for i, t in enumerate(texts)]
                bands = [keys[i].tolist() if names[i] else [] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, len(texts)), b.column(1).slice(begin, len(texts)), pa.array(names, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], [ID, "doc_id", "key", "bands"])

    rows = docs.select(ID, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"{ID} long, doc_id long, key binary, bands array<long>"), "signatures")


def elements(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """The bags of the named nodes, as sorted 64-bit numbers: the copies of a shingle are told
    apart by their number, so overlaps of bags are overlaps of sets."""

    def run(batches):
        for b in batches:
            for begin, texts in runs_of(texts_of(b.column(1))):
                value, doc, weight, _, _ = bags(texts)
                copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                whole = words.mix(np.repeat(value, weight) + copy.astype(np.uint64) * _STEP).view(np.int64)
                ends = np.cumsum(np.bincount(np.repeat(doc, weight), minlength=len(texts)))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(whole, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(texts)), lists], ["node", "bag"])

    nodes = written(nodes, "nodes")
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    rows = docs.select(F.col(ID).alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi")
    return written(rows.mapInArrow(run, "node long, bag array<long>"), "bags")


def similar(pairs: DataFrame, bag: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bags overlap by ``percent`` of their union or more."""
    left = bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    union = F.size("bag_a") + F.size("bag_b") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Smallest node of each node's connected component: node, label. Written.

    Each round a node takes the smallest label among its neighbours and its label's own label.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    ends = written(ends, "link-ends")
    labels = written(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        asked = ends.unionAll(labels.select("node", F.col("label").alias("other")))
        seen = asked.join(theirs, "other").select("node", F.col("theirs").alias("label"), F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        new = written(seen.unionAll(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        changed = not new.where("label < old").isEmpty()
        discard(labels)
        labels = new.select("node", "label")
        if not changed:
            discard(ends)
            return labels


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (bucket, node, rank, label) of the buckets whose nodes are in more than one class."""
    if labels is None:
        named = buckets.withColumn("label", F.col("node"))
    else:
        named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return written(named.join(mixed.select("bucket"), "bucket", "left_semi"), "open-buckets")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """Members (bucket, node, rank) of buckets of two nodes or more. The rank is the number of
    bucket mates of a node: the middle of a group of near copies has most. Written."""
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1")
    members = written(spread.join(shared, "bucket"), "shared-buckets")
    ranks = members.groupBy("node").agg(F.sum("mates").alias("rank"))
    return written(members.join(ranks, "node").select("bucket", "node", "rank"), "buckets")


def _rest(open_: DataFrame, bag: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, y) of nodes in different classes that can still be similar.

    An exact prefix filter: bags are put in one order, rarest elements first. If two bags
    overlap by ``percent`` of their union, the shorter one's first n - ceil(2p/(100+p) n) + 1
    elements and the longer one's first n - ceil(p/100 n) + 1 have one in common. Elements
    that no other bag has cannot be in an overlap, which bounds it from above. One side of a
    pair is outside the largest class of some bucket.
    """
    classes_ = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = classes_.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    minor = open_.join(largest, "bucket").groupBy("node", "label").agg(F.max(F.col("label") != F.col("largest")).alias("minor"))
    elements_ = bag.join(minor, "node").select("node", "label", "minor", F.size("bag").alias("n"), F.explode("bag").alias("element"))
    common = elements_.groupBy("element").agg(F.count(F.lit(1)).alias("seen"))
    order = elements_.join(common, "element").groupBy("node", "label", "minor", "n").agg(
        F.sum((F.col("seen") == 1).cast("int")).alias("alone"), F.sort_array(F.collect_list(F.struct("seen", "element"))).alias("order"))
    least = lambda share: (F.col("n") - F.ceil(F.col("n") * share) + 1).cast("int")
    order = order.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    prefix = order.select("node", "label", "minor", "n", (F.col("n") - F.col("alone")).alias("most"),
                          least(2 * percent / (100 + percent)).alias("short"), F.posexplode(F.slice("order", 1, least(percent / 100))).alias("at", "e"))
    prefix = written(prefix.where("e.seen > 1").withColumn("element", F.col("e.element")).drop("e"), "prefixes")
    x, y = (prefix.select("element", F.struct("n", "node").alias(s), F.struct("label", "minor", "most", "short", "at").alias(f"{s}_")) for s in "xy")
    # Where this is the first element in common, all others come after it in both bags.
    overlap = F.least("x_.most", "y_.most", F.col("x.n") - F.col("x_.at"), F.col("y.n") - F.col("y_.at"))
    close = (F.col("x") < F.col("y")) & (100 * F.col("x.n") >= percent * F.col("y.n")) & (
        (100 + percent) * overlap >= percent * (F.col("x.n") + F.col("y.n")))
    wanted = (F.col("x_.at") < F.col("x_.short")) & (F.col("x_.label") != F.col("y_.label")) & (F.col("x_.minor") | F.col("y_.minor"))
    return x.where("x_.at < x_.short").join(y, "element").where(close & wanted).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))


def links_of(docs: DataFrame, nodes: DataFrame, text: str, percent: int) -> DataFrame | None:
    """Labels of all nodes that have a link; None if there is none. ``nodes`` has node and bands."""
    buckets = _buckets(nodes)
    bag = elements(docs, buckets.select("node").distinct(), text)
    labels = tested = links = None
    open_ = _labelled(buckets, labels)
    lead = open_.groupBy("bucket").agg(F.max_by("node", F.struct("rank", "node")).alias("x"))
    found = open_.join(lead, "bucket").where("node != x").select("x", F.col("node").alias("y"))
    tested, links, labels = _joined(tested, links, labels, _test(_ordered(found), tested, bag, percent))
    open_ = _labelled(buckets, labels)
    if open_.isEmpty():
        return labels
    return _joined(tested, links, labels, _test(_ordered(_rest(open_, bag, percent)), tested, bag, percent))[2]


def _test(pairs: DataFrame, tested: DataFrame | None, bag: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs")
    return pairs, written(similar(pairs, bag, percent), "links")


def _joined(tested, links, labels, new):
    """Everything with a round's pairs and links added."""
    pairs, found = new
    tested = pairs if tested is None else tested.unionAll(pairs)
    if found.isEmpty():
        return tested, links, labels
    links = found if links is None else links.unionAll(found)
    return tested, links, components(links)


def _classes(docs: DataFrame, text: str, doc_id: str, percent: int, empty_alike: bool = False) -> DataFrame:
    """Per row of a numbered table: _llm_id, doc_id, label of its class. Written."""
    rows = signed(docs, text, doc_id)
    if empty_alike:
        rows = rows.withColumn("key", F.coalesce("key", F.lit("").cast("binary")))
    nodes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(ID).alias("node"))
    member = written(rows.join(nodes, "key", "left").select(
        ID, "doc_id", F.coalesce("node", ID).alias("node"), F.when(F.col("node") == F.col(ID), F.col("bands")).alias("bands")), "members")
    labels = links_of(docs, member.where(F.col("bands").isNotNull()).select("node", "bands"), text, percent)
    member = member.select(ID, "doc_id", "node")
    if labels is None:
        return member.withColumnRenamed("node", "label")
    return written(member.join(labels, "node", "left").select(ID, "doc_id", F.coalesce("label", "node").alias("label")), "classes")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """Per row: doc_id, class_id (the class's smallest doc_id), class_size (rows of the class)."""
    rows = _classes(kept_numbers(docs.select(doc_id, text)), text, doc_id, percent)
    sizes = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(sizes, "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """One document of each class, the one of the smallest id, with all its columns."""
    kept = kept_numbers(docs)
    rows = _classes(kept, text, doc_id, percent, empty_alike=True)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ID))).alias("first"),
                                      F.count(F.lit(1)).alias("n")).where("n > 1")
    dropped = written(rows.join(first.select("label", F.col(f"first.{ID}").alias("kept")), "label").where(f"{ID} != kept").select(ID), "copies")
    return packed(kept, docs.columns, ID).join(dropped, ID, "left_anti").select(f"{ROW}.*")
