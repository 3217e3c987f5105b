"""Text measures as native Column expressions.

All of them follow Python's string semantics (what counts as white space, digit, upper
case, line break) and none leaves the JVM. Words are wanted by most measures, so each
function that needs them accepts the word array of a previous ``withColumn``; the text is
then split once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.functions import fixed as X

UPPER = r"\p{IsUppercase}"
ALNUM = r"\p{L}\p{N}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """White-space separated tokens, in order."""
    return F.array_remove(F.split(_col(text), f"[{X.WHITESPACE}]+"), "")


def with_words(df: DataFrame, text: str = "extracted_text", name: str = "_words") -> DataFrame:
    return df.withColumn(name, words(text))


def _words(text, given) -> Column:
    return words(text) if given is None else _col(given)


def strip(text) -> Column:
    return F.btrim(_col(text), F.lit(X.WHITESPACE_CHARS))


def word_count(text, words_col=None) -> Column:
    return F.size(_words(text, words_col))


def char_count(text) -> Column:
    return F.char_length(_col(text))


def sentence_count(text) -> Column:
    """Number of non-blank pieces between full stops."""
    return F.regexp_count(_col(text), F.lit(f"[^.{X.WHITESPACE}][^.]*"))


def preview(text, limit: int = 1000) -> Column:
    """The first ``limit`` characters, with dots when something was cut."""
    text = _col(text)
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def preview_with_dots(text, limit: int = 200) -> Column:
    """The first ``limit`` characters, always with dots behind them."""
    return F.concat(cut(text, limit), F.lit("..."))


def cut(text, limit: int) -> Column:
    return F.substring(_col(text), 1, limit)


def clean_text(text) -> Column:
    """Strip every line, break it at double blanks, drop blanks, join by one blank."""
    pieces = F.split(_col(text), f"[{X.LINE_BREAKS}]|  ")
    return F.array_join(F.array_remove(F.transform(pieces, strip), ""), " ")


# ---------------------------------------------------------------------------- ratios


def _per(count: Column, total: Column) -> Column:
    return count / F.greatest(total, F.lit(1))


def unique_word_ratio(text, words_col=None, distinct_col=None) -> Column:
    w = _words(text, words_col)
    return _per(F.size(F.array_distinct(w) if distinct_col is None else _col(distinct_col)), F.size(w))


def marks(text) -> Column:
    """The text without lower-case letters, letters that have no case, and white space.

    None of these is a capital, a digit or a special character, and they are most of a text:
    the three ratios count in what is left when it is given to them.
    """
    return F.regexp_replace(_col(text), rf"[\p{{Ll}}\p{{Lo}}{X.WHITESPACE}]+", "")


def _count(others: str, text, marks_col) -> Column:
    """Number of characters that are left without the others; matches would be listed to be counted."""
    return F.char_length(F.regexp_replace(_col(text if marks_col is None else marks_col), f"[{others}]+", ""))


def capital_ratio(text, marks_col=None) -> Column:
    return _per(_count(f"^{UPPER}", text, marks_col), char_count(text))


def digit_ratio(text, marks_col=None) -> Column:
    return _per(_count(f"^{X.DIGITS}", text, marks_col), char_count(text))


def special_char_ratio(text, marks_col=None) -> Column:
    """Share of characters that are neither alphanumeric nor white space."""
    return _per(_count(f"{ALNUM}{X.WHITESPACE}", text, marks_col), char_count(text))


def avg_word_length(text, words_col=None) -> Column:
    w = _words(text, words_col)
    return _per(F.char_length(F.array_join(w, "")), F.size(w))


def has_numbers(text) -> Column:
    return _col(text).rlike(f"[{X.DIGITS}]")


def has_special_chars(text) -> Column:
    """True when any character is not alphanumeric; white space counts as special here."""
    return _col(text).rlike(f"[^{ALNUM}]")


# ------------------------------------------------------------- sentiment, readability


def _lexicon_hits(w: Column, lexicon: list[str]) -> Column:
    return F.filter(F.transform(w, F.lower), lambda x: x.isin(lexicon))


def _lexicon(words_: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in words_])


def sentiment_score(text, words_col=None) -> Column:
    """(positive - negative occurrences) / words; tokens are compared whole and lower-cased."""
    w = _words(text, words_col)
    hits = _lexicon_hits(w, X.POSITIVE_WORDS + X.NEGATIVE_WORDS)
    positive = F.size(F.filter(hits, lambda x: x.isin(X.POSITIVE_WORDS)))
    return _per(2 * positive - F.size(hits), F.size(w))


def readability_score(text, words_col=None) -> Column:
    """100 minus words per sentence, not below 0; 0 when there is no word or sentence."""
    n_words, n_sentences = word_count(text, words_col), sentence_count(text)
    return F.when(
        (n_words > 0) & (n_sentences > 0),
        F.greatest(F.lit(0.0), 100 - n_words / F.greatest(n_sentences, F.lit(1))),
    ).otherwise(0.0)


def rule_hits(words_col) -> Column:
    """The set of lexicon words among the words; as a column of its own it is worked out once a row.

    Words hold no blanks, so all of them are lower-cased in one string.
    """
    lowered = F.split(F.lower(F.array_join(words_col, " ")), " ")
    return F.array_intersect(lowered, _lexicon(X.RULE_POSITIVE_WORDS + X.RULE_NEGATIVE_WORDS))


def rule_sentiment(text, words_col=None, hits_col=None) -> Column:
    """struct(sentiment, confidence) over the *set* of words of the text."""
    hits = rule_hits(_words(text, words_col)) if hits_col is None else _col(hits_col)
    total = F.size(hits)
    positive = F.size(F.array_intersect(hits, _lexicon(X.RULE_POSITIVE_WORDS)))
    sentiment = F.when(total > 0, (2 * positive - total) / F.greatest(total, F.lit(1))).otherwise(0.0)
    return F.struct(
        sentiment.alias("sentiment"),
        F.least(F.abs(sentiment) * 2, F.lit(1.0)).alias("confidence"),
    )


def insight_text(count) -> Column:
    return F.concat(F.lit("Processed file with "), _col(count).cast("string"), F.lit(" words"))


# ---------------------------------------------------------------------------- bundles


def basic_analytics(text, words_col=None) -> Column:
    return F.struct(
        word_count(text, words_col).alias("word_count"),
        char_count(text).alias("char_count"),
        sentence_count(text).alias("sentence_count"),
        sentiment_score(text, words_col).alias("sentiment_score"),
        readability_score(text, words_col).alias("readability_score"),
    )


def engineered_features(text, words_col=None) -> Column:
    return F.struct(
        has_numbers(text).alias("has_numbers"),
        has_special_chars(text).alias("has_special_chars"),
        avg_word_length(text, words_col).alias("avg_word_length"),
        capital_ratio(text).alias("capital_ratio"),
    )


ML_FEATURES = [
    "word_count", "char_count", "sentence_count", "avg_word_length",
    "unique_word_ratio", "capital_ratio", "digit_ratio", "special_char_ratio",
]


def _with_parts(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows that have a text, with the parts of it that several measures are taken from."""
    rows = with_words(df.select(*keep, text).where(F.col(text).isNotNull()), text)
    return rows.withColumns({"_distinct": F.array_distinct("_words"), "_marks": marks(text)})


def _feature_columns(text: str) -> list[Column]:
    w, m = "_words", "_marks"
    features = {
        "word_count": word_count(text, w),
        "char_count": char_count(text),
        "sentence_count": sentence_count(text),
        "avg_word_length": avg_word_length(text, w),
        "unique_word_ratio": unique_word_ratio(text, w, "_distinct"),
        "capital_ratio": capital_ratio(text, m),
        "digit_ratio": digit_ratio(text, m),
        "special_char_ratio": special_char_ratio(text, m),
    }
    return [features[n].cast("double").alias(n) for n in ML_FEATURES]


def ml_features(df: DataFrame, text: str = "extracted_text", keep: tuple[str, ...] = ("data_id",)) -> DataFrame:
    """The eight numeric features of every text, as double columns."""
    return _with_parts(df, text, keep).select(*keep, *_feature_columns(text))


def ml_measures(df: DataFrame, text: str = "extracted_text", keep: tuple[str, ...] = ("data_id",)) -> DataFrame:
    """The features of every text with its rule sentiment, and whether it is valid; each text is split once."""
    rows = _with_parts(df, text, keep).withColumn("_hits", rule_hits("_distinct"))
    return rows.select(
        *keep, is_valid(text).alias("valid"), *_feature_columns(text), rule_sentiment(text, hits_col="_hits").alias("s")
    ).select(*keep, "valid", *ML_FEATURES, "s.sentiment", "s.confidence")


def is_valid(text, min_chars: int = 50) -> Column:
    """Is the stripped text longer than ``min_chars``? Where its beginning is, the rest is not looked at."""
    return (F.char_length(strip(cut(text, min_chars * 4))) > min_chars) | (F.char_length(strip(text)) > min_chars)


def valid_texts(df: DataFrame, text: str = "extracted_text", min_chars: int = 50) -> DataFrame:
    """Rows whose stripped text is longer than ``min_chars`` characters."""
    return df.where(is_valid(text, min_chars))


def filter_min_bytes(df: DataFrame, text: str = "extracted_text", min_bytes: int = 100) -> DataFrame:
    """Rows whose text takes more than ``min_bytes`` bytes in UTF-8."""
    return df.where(F.octet_length(F.col(text)) > min_bytes)
