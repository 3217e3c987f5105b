"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doclake.session import configure, written  # noqa: F401

# White space between words, everywhere in this subpackage: space and U+0009 to U+000D.
SPACE = " \\t\\n\\x0B\\f\\r"
ROW = "_llm_row"
ID = "_llm_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, after setting the session up."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The frame with the row number ``_llm_id``, which names a row even where its id is null or repeated.

    The number is the row's place in its partition, so it holds within one scan only: another
    scan of the same files may have other splits. Operators that read the rows twice use
    :func:`kept_numbers`.
    """
    return df.withColumn(ID, F.monotonically_increasing_id())


def kept_numbers(df: DataFrame) -> DataFrame:
    """:func:`numbered`, written once: every later read finds the same number beside a row."""
    return written(numbered(df), "numbered")


def packed(df: DataFrame, columns: list[str] | None = None, *beside: str) -> DataFrame:
    """The frame, or its named columns, as one struct ``_llm_row``: columns added later cannot clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias(ROW), *beside)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch of a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def runs_of(texts: list, max_bytes: int = 1 << 21) -> Iterator[tuple[int, list]]:
    """A batch's texts in runs of about ``max_bytes`` characters, with the place each run begins."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_bytes:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]
