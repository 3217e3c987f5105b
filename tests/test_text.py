"""Text measures against plain Python on texts that try every rule."""

import math
import re

import pytest
from pyspark.sql import functions as F

from doclake.functions import fixed as X, text as TX

EDGE = [
    "", "   ", "\t\n", "one", "a b c d e f g h i", "a b c d e f g h i j", "w " * 49, "w " * 50,
    "x" * 1000, "x" * 1001, "Good good. bad!", "good GOOD great terrible", "NULL NULLNULL undefined �",
    "a b　c d", "x²①٣", "Ⅷ ǅ É", "é café", "\U0001f600 ok \U0001f600",
    "...", "a..b. .c", "a\x1cb\x1dc\x0bd\x0ce\x85f", "Line one.  Two  blanks\r\n\r\n  indented\ttab   end",
    "⑴ ❶ ፩", "Straße İstanbul ΣΣ", "superb SUPERB mediocre superb", "A.b.C. d", "  lead and trail  ",
    "perfect awful brilliant poor", "_under_score_ -dash-", "1234567890", "\U00010a40 \U0001f101",
]


def measures(t: str) -> dict:
    words = t.split()
    n = max(len(words), 1)
    c = max(len(t), 1)
    lower = t.lower().split()
    sentences = sum(not (piece == "" or piece.isspace()) for piece in t.split("."))
    signs = [(w in X.RULE_POSITIVE_WORDS) - (w in X.RULE_NEGATIVE_WORDS) for w in set(lower)]
    marked = [s for s in signs if s]
    sentiment = sum(marked) / len(marked) if marked else 0.0
    pieces = [x.strip() for x in re.split("\n|  ", "\n".join(t.splitlines()))]
    return {
        "word_count": len(words), "char_count": len(t), "sentence_count": sentences,
        "clean": " ".join(x for x in pieces if x),
        "preview": t[:1000] + "..." if len(t) > 1000 else t,
        "strip": t.strip(),
        "unique": len(set(words)) / n,
        "capital": len(list(filter(str.isupper, t))) / c,
        "digit": len(list(filter(str.isdigit, t))) / c,
        "special": (len(t) - len(list(filter(str.isalnum, t))) - len(list(filter(str.isspace, t)))) / c,
        "avg_word": len("".join(words)) / n,
        "has_numbers": bool(list(filter(str.isdigit, t))),
        "has_special": t != "" and not t.isalnum(),
        "sentiment": sum((w in X.POSITIVE_WORDS) - (w in X.NEGATIVE_WORDS) for w in lower) / n,
        "readability": max(0, 100 - len(words) / sentences) if words and sentences else 0.0,
        "rule": sentiment, "confidence": min(abs(sentiment) * 2, 1.0),
    }


COLUMNS = {
    "word_count": TX.word_count, "char_count": TX.char_count, "sentence_count": TX.sentence_count,
    "clean": TX.clean_text, "preview": TX.preview, "strip": TX.strip, "unique": TX.unique_word_ratio,
    "capital": TX.capital_ratio, "digit": TX.digit_ratio, "special": TX.special_char_ratio,
    "avg_word": TX.avg_word_length, "has_numbers": TX.has_numbers, "has_special": TX.has_special_chars,
    "sentiment": TX.sentiment_score, "readability": TX.readability_score,
    "rule": lambda t: TX.rule_sentiment(t)["sentiment"], "confidence": lambda t: TX.rule_sentiment(t)["confidence"],
}


@pytest.fixture(scope="module")
def measured(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)), "id int, t string")
    rows = df.select("id", *[f("t").alias(name) for name, f in COLUMNS.items()]).orderBy("id").collect()
    return rows


@pytest.mark.parametrize("name", list(COLUMNS))
def test_measure(measured, name):
    for text, row in zip(EDGE, measured):
        want = measures(text)[name]
        got = row[name]
        same = math.isclose(got, want) if isinstance(want, float) else got == want
        assert same, (text, got, want)


def test_ratios_are_ratios(measured):
    for row in measured:
        for name in ("unique", "capital", "digit", "special"):
            assert 0 <= row[name] <= 1
        assert abs(row["sentiment"]) <= 1 and abs(row["rule"]) <= 1


def test_features_and_filters(spark):
    df = spark.createDataFrame([("a", "x" * 101), ("b", "é" * 51), ("c", "x" * 100), ("d", None), ("e", "  ")],
                               "data_id string, extracted_text string")
    assert {r[0] for r in TX.filter_min_bytes(df).collect()} == {"a", "b"}
    assert {r[0] for r in TX.valid_texts(df).collect()} == {"a", "b", "c"}
    features = {r["data_id"]: r for r in TX.ml_features(df).collect()}
    assert set(features) == {"a", "b", "c", "e"}  # a NULL text has no features
    assert features["e"]["avg_word_length"] == 0.0
    assert [f for f in features["a"].asDict() if f != "data_id"] == TX.ML_FEATURES


def test_all_measures_in_one_pass(spark):
    """Together with the parts they share, measures are what each gives alone, for every character there is."""
    space = " ".join(X.WHITESPACE_CHARS)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(every[i:i + 64]) for i in range(0, len(every), 64) if "".join(every[i:i + 64]).strip()]
    texts = [*EDGE, *blocks, "GOOD Bad\u2003good bAd. " + space, "superb " * 20, "\u212a\u0130good good\u0130 \u03a3", "x" * 50, "x" * 51,
             " " * 300 + "x" * 50 + " " * 300, " " * 300 + "x" * 51 + " ", "y" + " " * 250 + "y", "y" + " " * 49 + "y", "y" + " " * 48 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "data_id int, extracted_text string")
    df = df.repartition(8)
    t = "extracted_text"
    alone = df.where(F.col(t).isNotNull()).select(
        "data_id", (F.char_length(TX.strip(t)) > 50).alias("valid"),
        F.regexp_count(t, F.lit(r"\p{IsUppercase}")).alias("capitals"), F.regexp_count(t, F.lit(f"[{X.DIGITS}]")).alias("digits"),
        F.regexp_count(t, F.lit(rf"[^\p{{L}}\p{{N}}{X.WHITESPACE}]")).alias("specials"), F.char_length(t).alias("n"), F.col(t).alias("t"))
    together = {r["data_id"]: r for r in TX.ml_measures(df).collect()}
    features = {r["data_id"]: r for r in TX.ml_features(df).collect()}
    assert set(together) == set(features) == set(range(len(texts)))
    lexicon = {w: s for words, s in ((X.RULE_POSITIVE_WORDS, 1), (X.RULE_NEGATIVE_WORDS, -1)) for w in words}
    for r in alone.collect():
        got, n = together[r["data_id"]], max(r["n"], 1)
        assert got["valid"] == r["valid"]
        assert (got["capital_ratio"], got["digit_ratio"], got["special_char_ratio"]) == (r["capitals"] / n, r["digits"] / n, r["specials"] / n)
        assert [got[f] for f in TX.ML_FEATURES] == [features[r["data_id"]][f] for f in TX.ML_FEATURES]
        found = [lexicon[w] for w in {w.lower() for w in r["t"].split()} if w in lexicon]
        assert math.isclose(got["sentiment"], sum(found) / max(len(found), 1))
        assert math.isclose(got["confidence"], min(abs(got["sentiment"]) * 2, 1.0))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "x")], "data_id string, extracted_text string")
    plan = TX.ml_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
