"""Quality checks of documents, and key checks of tables.

A check is a Column of type struct(value double, status string).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from doclake.functions import fixed as X, text as TX

CHECKS = ["completeness", "validity", "consistency", "uniqueness", "accuracy"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _result(value, status) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(value).cast("double").alias("value"), lit(status).alias("status"))


def completeness(text, words_col=None) -> Column:
    n = TX.word_count(text, words_col)
    return (
        F.when(_col(text).isNull() | (n == 0), _result(0.0, "failed"))
        .when(n < 10, _result(0.3, "poor"))
        .when(n < 50, _result(0.6, "fair"))
        .otherwise(_result(0.9, "good"))
    )


def _occurrences(text: Column, needle: str) -> Column:
    removed = F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")


def validity(text, words_col=None, max_chars: int = 1_000_000) -> Column:
    text = _col(text)
    hits = reduce(lambda a, b: a + b, [_occurrences(text, m) for m in X.INVALID_MARKERS])
    score = F.greatest(F.lit(0.0), 1 - hits / F.greatest(TX.word_count(text, words_col), F.lit(1)))
    return F.when(F.char_length(text) > max_chars, _result(0.2, "poor")).when(
        text.isNotNull(), _result(score, F.when(score > 0.8, "good").otherwise("poor"))
    )


def consistency(file_type, content_type, mode: str = "literal") -> Column:
    """Does the type of the file agree with the type of its content?

    ``literal`` compares the two columns as they are; ``category`` first maps a file
    extension to its category, which is what ingestion stores as content type.
    """
    declared, found = F.coalesce(_col(file_type), F.lit("")), F.coalesce(_col(content_type), F.lit(""))
    if mode == "category":
        from doclake.functions.scalars import file_category

        declared = file_category(declared)
    elif mode != "literal":
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(declared == found, _result(0.9, "good")).otherwise(_result(0.5, "fair"))


def uniqueness(text, words_col=None) -> Column:
    ratio = TX.unique_word_ratio(text, words_col)
    return F.when(ratio.isNotNull(), _result(ratio, F.when(ratio > 0.7, "good").otherwise("fair")))


def accuracy() -> Column:
    return _result(0.8, "good")


def _named(name: str, check: Column) -> Column:
    return F.struct(F.lit(name).alias("check_type"), check["value"].alias("check_value"), check["status"].alias("status"))


def check_array(text="extracted_text", file_type="file_type", content_type="content_type",
                words_col=None, mode: str = "literal") -> Column:
    """All checks of one document, in order.

    A NULL text fails completeness and ends with an ``error`` entry in place of the rest.
    """
    first = _named("completeness", completeness(text, words_col))
    return F.when(
        _col(text).isNull(), F.array(first, _named("error", _result(0.0, "failed")))
    ).otherwise(
        F.array(
            first,
            _named("validity", validity(text, words_col)),
            _named("consistency", consistency(file_type, content_type, mode)),
            _named("uniqueness", uniqueness(text, words_col)),
            _named("accuracy", accuracy()),
        )
    )


def quality_checks(docs: DataFrame, text="extracted_text", mode: str = "literal",
                   keep: tuple[str, ...] = ("data_id", "file_id")) -> DataFrame:
    """One row per document and check: keep columns, check_type, check_value, status."""
    checks = TX.with_words(docs, text).select(*keep, check_array(text, words_col="_words", mode=mode).alias("c"))
    # The outer form: for a plain generator the optimizer adds a not-empty filter, which
    # would compute all the checks a second time. No array here is empty.
    return checks.select(*keep, F.inline_outer("c"))


def quality_rules(docs: DataFrame, text="extracted_text", min_words: int = 10, max_size_mb: int = 100,
                  require_text: bool = True, check_completeness: bool = True, check_validity: bool = True,
                  check_consistency: bool = True, keep: tuple[str, ...] = ("data_id", "file_id")) -> DataFrame:
    """Violations of user-set rules: keep columns and the name of each broken rule."""
    w = F.col("_words")
    size = F.col("file_size")
    broken = {
        "min_word_count": F.coalesce(F.size(w), F.lit(0)) < min_words,
        "max_file_size": size > max_size_mb * 1024 * 1024,
    }
    if require_text:
        broken["require_text_content"] = F.coalesce(TX.strip(text), F.lit("")) == ""
    if check_completeness:
        broken["completeness"] = completeness(text, w)["status"] != "good"
    if check_validity:
        broken["validity"] = validity(text, w)["status"] != "good"
    if check_consistency:
        broken["consistency"] = consistency("file_type", "content_type")["status"] != "good"
    flags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in broken.items()]))
    # F.size of a NULL array is NULL under ANSI mode and -1 otherwise; both count as no word.
    # The outer form keeps the optimizer from evaluating the rules twice.
    return TX.with_words(docs, text).select(*keep, F.explode_outer(flags).alias("rule")).where("rule IS NOT NULL")


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphan_rows(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    return child.where(F.col(column).isNotNull()).join(parent.select(column), column, "left_anti")
