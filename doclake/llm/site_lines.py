"""Line dedup by frequency on the site.

For each host, the pages that contain a line are divided by the host's pages; a line above
``ratio`` and on ``min_pages`` pages or more is boilerplate there and is cut from every page
of the host. Lines are compared without surrounding white space; lines without any text are
never cut and never counted.

Counting groups by (host, line hash), which combines before the shuffle, so a line on a
third of all pages is one row per task. A host's boilerplate is short by nature: at most
(lines of a page on average) / ratio. It is joined to the pages as one array per host.
Lines are known by a 64-bit hash and their length.

With ``tell_copies`` the lines of copied pages are not taken for boilerplate, so near-dedup
still finds a full copy to keep. The host's pages are then its distinct texts. A line is cut
if it is on most pages, above ``MOST`` of them and one root of their number more (all 5 of 5,
21 of 30, 532 of 1000; no line of a host of up to 4 pages). Between ``ratio`` and that, it is
cut if it is on ``min_pages`` or more that otherwise differ: near copies share the smallest
hash of their other lines, so there have to be ``SPREAD`` times as many such hashes as pages.
A page of nothing but boilerplate keeps its text. What is left open: near copies that are most
of their host's distinct texts lose the lines they share.

Defined cases: null texts have no lines and stay null; null hosts form one host; repeated
rows count as pages each, with ``tell_copies`` once; a page all of whose lines are boilerplate
keeps its row, with what is left of its text, with ``tell_copies`` all of it. Other columns
pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import ROW, SPACE, let, packed, written


MOST, SPREAD = 0.5, 0.5


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\f\r"))


def _key(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05,
                min_pages: int = 3, tell_copies: bool = False) -> DataFrame:
    """One row per host with boilerplate: host, and the hashes of its boilerplate lines."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(text, F.length(text)).alias("page"))
    keys = F.transform(
        F.filter(F.split(F.col("text"), "\n"), lambda s: s.rlike(f"[^{SPACE}]")), lambda s: _key(_trimmed(s))
    )
    # The page itself is counted as a null line, so that one pass gives both counts.
    every = F.concat(F.array(F.lit(None).cast("long")), F.coalesce(F.array_distinct(keys), F.array().cast("array<bigint>")))
    if tell_copies:
        # Each line with the smallest hash of the page's other lines.
        lines = pages.select("host", "page", F.explode_outer(let(every, _beside)).alias("s")).select("host", "page", "s.line", "s.beside")
        alike = lines.distinct().groupBy("host", "line", "beside").agg(F.count(F.lit(1)).alias("n"))
        counts = alike.groupBy("host", "line").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("differ"))
    else:
        lines = pages.select("host", F.explode_outer(every).alias("line"))
        counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    least = min(min_pages, 3)
    counts = written(counts.where(F.col("line").isNull() | (F.col("pages") >= least)), "line-counts")
    totals = counts.where(F.col("line").isNull()).select(F.col("host").alias("h"), F.col("pages").alias("total"))
    common = counts.where(F.col("line").isNotNull()).join(totals, F.col("host").eqNullSafe(F.col("h")))
    above = (F.col("pages") >= min_pages) & (F.col("pages") > F.col("total") * F.lit(ratio))
    if tell_copies:
        most = F.col("pages") > F.col("total") * F.lit(MOST) + F.sqrt("total")
        above = most | above & (F.col("differ") >= F.col("pages") * F.lit(SPREAD))
    return common.where(above).groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _beside(every: Column) -> Column:
    """Each line of a page with the smallest of its other lines; the page's own null line has none."""

    def paired(low: Column) -> Column:
        return F.transform(every, lambda k: F.struct(k.alias("line"), F.when(k == F.get(low, F.lit(0)), F.get(low, F.lit(1))).when(
            k.isNotNull(), F.get(low, F.lit(0))).alias("beside")))

    return let(F.slice(F.array_sort(F.array_compact(every)), 1, 2), paired)


def _cut(text: Column, lines: Column, whole: bool) -> Column:
    """Text without the listed lines, and how many lines it had and lost."""

    def by_line(found: Column, all_lines: Column) -> Column:
        kept = F.filter(all_lines, lambda s: ~F.array_contains(found, s["key"]))
        if whole:
            kept = F.when(F.exists(kept, lambda s: s["full"]), kept).otherwise(all_lines)
        return F.struct(
            F.array_join(F.transform(kept, lambda s: s["line"]), "\n").alias("text"),
            F.size(F.filter(all_lines, lambda s: s["full"])).cast("long").alias("n_lines"),
            (F.size(all_lines) - F.size(kept)).cast("long").alias("n_dropped"),
        )

    def marked(s: Column) -> Column:
        full = s.rlike(f"[^{SPACE}]")
        return F.struct(s.alias("line"), full.alias("full"),
                        F.when(full, _key(_trimmed(s))).otherwise(F.lit(0)).alias("key"))

    def of_lines(all_lines: Column) -> Column:
        own = F.transform(F.filter(all_lines, lambda s: s["full"]), lambda s: s["key"])
        return let(F.array_intersect(own, lines), lambda found: by_line(found, all_lines))

    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), marked)
    return let(split, of_lines)


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3,
               counts: bool = False, tell_copies: bool = False) -> DataFrame:
    """The documents with boilerplate lines cut from their text.

    With ``counts`` the result is one struct ``_llm_row`` of the input's columns (cut text)
    beside n_lines and n_dropped.
    """
    found = written(boilerplate(docs, text, host, ratio, min_pages, tell_copies), "boilerplate").select(
        F.col("host").alias("_llm_host"), F.col("lines").alias("_llm_lines"))
    rows = packed(docs)
    joined = rows.join(found, F.col(f"{ROW}.`{host}`").eqNullSafe(F.col("_llm_host")), "left")
    lines = F.coalesce("_llm_lines", F.array().cast("array<bigint>"))
    cut = joined.select(ROW, _cut(F.col(f"{ROW}.`{text}`"), lines, tell_copies).alias("_llm_cut"))
    value = F.when(F.col(f"{ROW}.`{text}`").isNotNull(), F.col("_llm_cut.text"))
    row = F.struct(*[value.alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])
    out = cut.select(row.alias(ROW), F.col("_llm_cut.n_lines").alias("n_lines"), F.col("_llm_cut.n_dropped").alias("n_dropped"))
    return out if counts else out.select(f"{ROW}.*")
