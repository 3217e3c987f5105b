"""Quality rules of single documents, judged again by host.

Every document is measured and tested by simple rules. Failures of each rule are summed by
host; a host's failure rate is shrunk towards all hosts by a beta prior fitted to the rates
themselves (method of moments), so a host of three pages is not judged by three pages. A
document goes if it fails a base rule, or if its host is bad: some rule's shrunken rate is
above ``host_limit``. All of it is DataFrame functions; measures are written once, and the
verdict of a host is joined back to its documents.

Defined cases: a null text has no words, so fails ``short``; null hosts form one host;
repeated rows count each; an empty table gives an empty result. Columns of the input other
than the named ones are ignored by :func:`judge` and passed on unchanged by :func:`keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import ROW, SPACE, let, packed, words_of, written


@dataclass
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_percent: int = 20  # symbols per 100 words
    max_dup_lines_percent: int = 50
    host_limit: float = 0.8


# Rules that reject a document by themselves, and rules that only count against its host.
BASE = ("short", "repeated")
RULES = (*BASE, "symbols", "dup_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MAX_STRENGTH = 1e6  # of the prior, where hosts do not differ


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a run of ``width`` words that the text has twice or more.

    Runs are sorted next to their equals; places of repeated runs, in order, each cover
    ``width`` words or those up to the next such place.
    """

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                           lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
        # zip_with pads the last place with null; its own step is the whole width
        return F.aggregate(F.slice(steps, 1, F.size(places)), F.lit(0), lambda s, x: s + x)

    def of_runs(runs: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(runs, i)["run"] == F.get(runs, j)["run"], F.lit(False))

        places = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: same(i, i - 1) | same(i, i + 1)),
            lambda i: F.get(runs, i)["place"],
        )
        return let(F.array_sort(places), covered)

    def of_words(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)]).alias("run"), i.alias("place")),
        )
        return F.when(F.size(w) > width, let(F.array_sort(runs), of_runs)).otherwise(0)

    return let(words, of_words)


def measures(text: Column) -> Column:
    """Words, characters, symbols and repeats of a text as one struct of longs."""
    whole = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    lines = let(F.filter(F.split(whole, "\n"), lambda s: s.rlike(f"[^{SPACE}]")), of_lines)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
                        repeated_words(w).alias("repeat"))

    def collected(w: Column, ln: Column) -> Column:
        values = (w["n"], w["chars"], F.regexp_count(whole, F.lit("[#*$%&|<>]")), ln["n"], ln["dup"], w["repeat"])
        return F.struct(*[v.cast("long").alias(name) for name, v in zip(MEASURES, values, strict=True)])

    return let(let(words_of(text), of_words), lambda w: let(lines, lambda ln: collected(w, ln)))


def failures(m: Column, limits: Limits) -> dict[str, Column]:
    """Rule name -> whether a document of these measures fails it."""
    return {
        "short": m["n_words"] < limits.min_words,
        "repeated": 100 * m["n_repeat_words"] > limits.max_repeat_percent * m["n_words"],
        "symbols": 100 * m["n_symbols"] > limits.max_symbols_percent * m["n_words"],
        "dup_lines": 100 * m["n_dup_lines"] > limits.max_dup_lines_percent * m["n_lines"],
    }


def host_rates(measured: DataFrame, limits: Limits) -> DataFrame:
    """One row per host: documents, and each rule's failure rate after shrinking."""
    fails = failures(F.col("m"), limits)
    hosts = written(measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(f.cast("long")).alias(r) for r, f in fails.items()]
    ), "hosts")
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("docs").alias("docs"),
                      *[F.sum(r).alias(r) for r in RULES],
                      *[F.sum(F.col(r) * F.col(r) / F.col("docs")).alias(f"{r}_sq") for r in RULES]).first()
    shrunk = []
    for r in RULES:
        a, b = beta_prior(total["hosts"], total["docs"] or 0, total[r] or 0, total[f"{r}_sq"] or 0.0)
        shrunk.append(((F.col(r) + a) / (F.col("docs") + (a + b))).alias(r))
    return hosts.select("host", "docs", *shrunk)


def beta_prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """The beta distribution of a rule's rate over hosts.

    ``squares`` is the sum of failures**2 / documents over hosts: with it the variance of
    the rates is known, of which the part that chance alone explains is taken off.
    """
    if not docs:
        return 1.0, 1.0
    mean = failed / docs
    chance = mean * (1 - mean) * hosts / docs
    spread = squares / docs - mean * mean - chance
    strength = MAX_STRENGTH if spread <= 0 else min(MAX_STRENGTH, max(1.0, mean * (1 - mean) / spread - 1))
    return max(mean * strength, 1e-9), max((1 - mean) * strength, 1e-9)


def _judged(measured: DataFrame, limits: Limits) -> DataFrame:
    """Rows with ``base_failed``, ``host_rejected`` and ``kept``; ``measured`` has host and m, and is a written table."""
    rates = host_rates(measured, limits)
    bad = F.greatest(*[F.col(r) for r in RULES]) > limits.host_limit
    verdict = written(rates.select(F.col("host").alias("_llm_host"), bad.alias("host_rejected")), "verdicts")
    fails = failures(F.col("m"), limits)
    base = fails["short"] | fails["repeated"]
    return (
        measured.join(verdict, F.col("host").eqNullSafe(F.col("_llm_host")), "left").drop("_llm_host")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
          limits: Limits | None = None) -> DataFrame:
    """Per document: its id, measures, base_failed, host_rejected, kept."""
    found = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"),
                                measures(F.col(text)).alias("m")), "measures")
    judged = _judged(found, limits or Limits())
    return judged.select("doc_id", "m.*", "base_failed", "host_rejected", "kept")


def keep(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits | None = None) -> DataFrame:
    """The documents that are kept, with all their columns.

    Documents are written once together with their measures; host rates read only the
    narrow columns of that table.
    """
    found = written(packed(docs).select(ROW, F.col(f"{ROW}.`{host}`").alias("host"),
                                        measures(F.col(f"{ROW}.`{text}`")).alias("m")), "measured")
    return _judged(found, limits or Limits()).where("kept").select(f"{ROW}.*")
