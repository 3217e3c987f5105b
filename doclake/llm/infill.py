"""Fill-in-middle: a text cut at two of its token boundaries and put in another order.

The boundaries of a text are a :class:`doclake.llm.boundaries.BoundarySet` of the last code points of
its tokens, built from 65 536 code points at a time; two ``select`` calls give the cuts. Units are
tokens (white space and the word behind it; white space at the end is a token of its own) or, with
``unit="char"``, single code points. Which cuts and which order a document gets depends on the sha256
of ``<seed>:<id>`` only, so a task that is run again gives the same. Only the two cuts are worked out
in Python; the parts are put together, and taken apart again by :func:`restore`, by Spark's functions.

Defined cases: a null text is empty; an empty text, and one that contains a mark, stays plain; a null
id is hashed as no digits; rows with equal ids get equal draws; an empty table gives an empty result.
All columns of the input, whatever their names, are passed on inside the struct ``_llm_row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.boundaries import BITS, RANGE, BoundarySet
from doclake.llm.common import ROW, let, packed, texts_of

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"


def _ranges(text: str, unit: str) -> Iterator[tuple[int, np.ndarray]]:
    """Last code points of the units, range by range."""
    for key in range((len(text) + RANGE - 1) >> BITS):
        # One code point more, to see whether the word at the end of the range goes on.
        code = np.frombuffer(text[key << BITS : (key + 1 << BITS) + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        n = min(len(code), RANGE)
        if unit == "char":
            yield key, np.arange(n)
            continue
        space = (code == 0x20) | (code - np.uint32(9) < 5)
        ends = ~space[:n]
        ends[: len(space) - 1] &= space[1:]
        if n == len(code):
            ends[-1] = True  # the text's end
        yield key, np.flatnonzero(ends)


def boundaries(text: str, unit: str = "token") -> BoundarySet:
    return BoundarySet(_ranges(text, unit))


def cuts(text: str, first: int, second: int, unit: str = "token") -> tuple[int, int, int]:
    """Units of the text, and the code points before the smaller and the larger of two draws modulo units + 1."""
    ends = boundaries(text, unit)
    places = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    return len(ends), *[ends.select(p - 1) + 1 if p else 0 for p in places]


_CUTS = "struct<n: bigint, low: bigint, high: bigint>"


def _cuts(unit: str):
    @F.arrow_udf(_CUTS)
    def run(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        found = [cuts(t, a, b, unit) for t, a, b in zip(texts_of(text), first.to_pylist(), second.to_pylist(), strict=True)]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "low", "high"])

    return run


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2**32 that depend on the id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _joined(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    return (F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
            .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of. Marks are three characters long and never inside a part."""

    def between(second: str, order) -> Column:
        def of_body(body: Column) -> Column:
            part = F.substring_index(body, second, 1)
            return let(F.struct(part.alias("a"), F.substring(body, F.length(part) + 4, F.length(body)).alias("rest")), of_rest)

        def of_rest(s: Column) -> Column:
            part = F.substring_index(s["rest"], MIDDLE, 1)
            return order(s["a"], part, F.substring(s["rest"], F.length(part) + 4, F.length(s["rest"])))

        return let(F.substring(output, F.lit(4), F.length(output)), of_body)

    return (F.when(form == "psm", between(SUFFIX, lambda prefix, suffix, middle: F.concat(prefix, middle, suffix)))
            .when(form == "spm", between(PREFIX, lambda suffix, prefix, middle: F.concat(prefix, middle, suffix)))
            .otherwise(output))


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, percent: int = 50,
              spm_percent: int = 80, unit: str = "token", columns: list[str] | None = None) -> DataFrame:
    """``_llm_row`` (the named columns, all by default) beside n (units), form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain) and output.

    ``percent`` of the documents that can be cut are; ``spm_percent`` of these put the suffix first.
    """
    drawn = [d.alias(f"h{i}") for i, d in enumerate(draws(F.col(f"`{doc_id}`"), seed), 1)]
    rows = packed(docs, columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *drawn)
    whole = F.col("text")
    plain = (whole == "") | (F.col("h3") % 100 >= percent)
    for mark in MARKS:
        plain = plain | F.contains(whole, F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.select(ROW, "text", form.alias("form"), _cuts(unit)("text", "h1", "h2").alias("c"))
    low, high, is_cut = F.col("c.low"), F.col("c.high"), F.col("form") != "plain"
    # substring counts in 32 bits, as the length of a string does.
    parts = [F.substring(whole, a.cast("int"), n.cast("int")) for a, n in
             ((F.lit(1), low), (low + 1, high - low), (high + 1, F.length(whole) - high))]
    return cut.select(
        ROW, F.col("c.n").alias("n"), "form", F.when(is_cut, low).alias("prefix_chars"), F.when(is_cut, high - low).alias("middle_chars"),
        F.coalesce(_joined(F.col("form"), *parts), whole).alias("output"))


def digests(transformed: DataFrame) -> DataFrame:
    """doc_id and what :func:`transform` found, the output and the text restored from it as sha256."""
    return transformed.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
