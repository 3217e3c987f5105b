"""Text files too large for one value, as parts in order that together are the whole text.

Spark splits such a file by bytes and gives every line to the split it begins in, so no character is
cut. Each task joins its lines to fragments of about ``part_bytes``. For CSV a fragment may end inside a
quoted cell: an odd number of quotes before its end says so. Such fragments are put together with the
next ones, up to the first that ends outside of quotes. The decision needs one narrow row per
fragment; texts are only moved where fragments are put together.

A line above ``MAX_LINE`` bytes, or a quoted cell that makes more than ``MAX_RECORD`` bytes of fragments, cannot
be one value; its file is an error. So is a file that is not valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from doclake.session import written

PART_BYTES = 16 << 20
MAX_LINE = 256 << 20
MAX_RECORD = 512 << 20
FRAGMENT = "file string, size long, split long, seq long, text binary, bytes long, quotes long"


def plain_path(uri: Column) -> Column:
    """The path of an encoded URI, as file sources write it."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def fragments(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """The lines of the files in runs of at least ``part_bytes``, or up to the end of a split; see ``FRAGMENT``."""
    lines = spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", str(MAX_LINE)).text(paths)
    lines = lines.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, of, seq = 0, None, 0

        def fragment() -> pa.RecordBatch:
            text = b"\n".join(held) + b"\n"
            row = (*of, seq, text, len(text), text.count(b'"'))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                                              [c.split()[0] for c in FRAGMENT.split(", ")])

        for b in batches:
            for *split, line in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (size >= part_bytes or split != of):
                    yield fragment()
                    seq, held, size = (seq + 1 if split == of else 0), [], 0
                of = split
                held.append(line)
                size += len(line) + 1
        if held:
            yield fragment()

    return lines.mapInArrow(run, FRAGMENT)


def read_parts(spark: SparkSession, paths: list[str], is_csv: Column, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (path, part, extracted_text, extract_error) of the files, ``part`` counting from 0.

    ``is_csv`` says of the column ``path`` whether its file is CSV. A file with an error is one row.
    """
    found = written(fragments(spark, paths, part_bytes), "fragments").withColumn("path", plain_path(F.col("file")))
    in_order = Window.partitionBy("path").orderBy("split", "seq")  # one narrow row per fragment
    so_far, whole = in_order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("path")
    valid = F.is_valid_utf8(F.col("text").cast("string"))
    facts = found.select("path", "size", "split", "seq", "bytes", F.when(is_csv, F.col("quotes")).otherwise(0).alias("quotes"), valid.alias("valid"))
    facts = facts.withColumn("open", F.sum("quotes").over(so_far) % 2 == 1)
    ended = F.sum(F.when(~F.col("open"), 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    facts = facts.withColumn("part", F.coalesce(ended, F.lit(0)).cast("long"))
    # Every line counts a line feed; the last one may have none. A mark of the byte order is not in the lines.
    facts = facts.withColumn("extra", F.sum("bytes").over(whole) - F.col("size")).withColumn("valid", F.min("valid").over(whole))
    facts = facts.withColumn("last", F.lead("part").over(in_order).isNull())
    record = Window.partitionBy("path", "part")
    facts = facts.withColumn("pieces", F.count("*").over(record)).withColumn("record", F.sum("bytes").over(record))
    facts = facts.withColumn("longest", F.max(F.when(F.col("pieces") > 1, F.col("record")).otherwise(0)).over(whole))
    error = (F.when(~F.col("extra").isin(0, 1, -3, -2), f"a line of more than {MAX_LINE} bytes")
             .when(~F.col("valid"), "not valid UTF-8")
             .when(F.col("longest") > MAX_RECORD, f"a quoted cell of more than {MAX_RECORD} bytes"))
    facts = written(facts.withColumn("error", error).select("path", "split", "seq", "part", "pieces", "extra", "last", "error"), "fragment-facts")

    texts = found.select("path", "split", "seq", "text").join(facts.where("error IS NULL"), ["path", "split", "seq"])
    text = F.when(F.col("last") & F.col("extra").isin(1, -2), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    first = (F.col("split") == 0) & (F.col("seq") == 0) & F.col("extra").isin(-3, -2)
    text = F.when(first, F.concat(F.lit(b"\xef\xbb\xbf"), text)).otherwise(text)
    texts = texts.withColumn("text", text)
    alone = texts.where("pieces = 1").select("path", "part", F.col("text").cast("string").alias("extracted_text"))
    joined = texts.where("pieces > 1").groupBy("path", "part").agg(F.sort_array(F.collect_list(F.struct("split", "seq", "text"))).alias("t"))
    joined = joined.select("path", "part", F.array_join(F.transform("t", lambda t: t["text"].cast("string")), "").alias("extracted_text"))
    failed = facts.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("extract_error"))
    good = alone.unionAll(joined).withColumn("extract_error", F.lit(None).cast("string"))
    return good.unionByName(failed.select("path", F.lit(0).cast("long").alias("part"), F.lit(None).cast("string").alias("extracted_text"), "extract_error"))
