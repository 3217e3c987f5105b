"""TF-IDF vectors with smoothed idf, as a persistable ML pipeline."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from doclake.session import written

# Runs of at least two word characters (letters, numbers, underscore).
TOKEN = r"[\p{L}\p{N}_]{2,}"


def default_stop_words() -> list[str]:
    """Spark's English list; pass another one where results must match another list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def _stages(text: str, stop_words: list[str] | None):
    tokenizer = RegexTokenizer(inputCol=text, outputCol="_raw", pattern=TOKEN, gaps=False, toLowercase=True)
    remover = StopWordsRemover(
        inputCol="_raw", outputCol="tokens", caseSensitive=True,
        stopWords=default_stop_words() if stop_words is None else list(stop_words),
    )
    return tokenizer, remover


def tokens(df: DataFrame, text: str = "extracted_text", stop_words: list[str] | None = None) -> DataFrame:
    """The frame with a ``tokens`` column: lower-cased terms without stop words."""
    tokenizer, remover = _stages(text, stop_words)
    return remover.transform(tokenizer.transform(df.where(F.col(text).isNotNull()))).drop("_raw")


def term_statistics(df: DataFrame, text: str = "extracted_text", stop_words: list[str] | None = None) -> DataFrame:
    """term, tf (occurrences), df (texts it occurs in), from one pass over the texts.

    Each text gives its tokens followed by its distinct tokens, so position tells the two
    counts apart. A leading empty token counts the texts: the row of term '' has their
    number as tf. Counts combine before the shuffle, so frequent terms are no hot keys.
    The explode is the outer form: the plain one would tokenize every text twice. Stop words
    are left out as terms, not text by text.
    """
    tokenizer, remover = _stages(text, stop_words)
    listed = F.concat(F.array(F.lit("")), "tokens", F.array_distinct("tokens"))
    raw = tokenizer.transform(df.select(text).where(F.col(text).isNotNull())).select(F.col("_raw").alias("tokens"))
    rows = raw.select(F.size("tokens").alias("n"), F.posexplode_outer(listed).alias("pos", "term"))
    stop = [w for w in remover.getStopWords() if w]
    return rows.where(~F.col("term").isin(stop)).groupBy("term").agg(
        F.count_if(F.col("pos") <= F.col("n")).alias("tf"), F.count_if(F.col("pos") > F.col("n")).alias("df")
    )


def term_idf(df: DataFrame, text: str = "extracted_text", min_df: int = 1,
             stop_words: list[str] | None = None) -> DataFrame:
    """term, df, idf over the whole vocabulary: idf = ln((1 + n) / (1 + df)) + 1.

    The statistics are written, because their row of the number of texts goes to all others:
    the texts are read once, and the second look is at one row per term.
    """
    counts = written(term_statistics(df, text, stop_words), "terms")
    n = counts.where("term = ''").agg(F.sum("tf")).scalar()
    return counts.where((F.col("df") >= min_df) & (F.col("term") != "")).select(
        "term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )


def vocabulary(df: DataFrame, text: str = "extracted_text", max_features: int = 1000,
               stop_words: list[str] | None = None) -> DataFrame:
    """The ``max_features`` most frequent terms with their counts; ties in term order."""
    known = term_statistics(df, text, stop_words).where("term <> ''")
    return known.orderBy(F.desc("tf"), "term").limit(max_features).select("term", F.col("tf").alias("count"))


def fit_tfidf(df: DataFrame, text: str = "extracted_text", max_features: int = 1000,
              stop_words: list[str] | None = None, out: str = "features",
              statistics: DataFrame | None = None) -> PipelineModel:
    """Fit vocabulary and idf in one pass; at most ``max_features`` + 1 rows reach the driver.

    Pass ``statistics`` (of :func:`term_statistics` with the same stop words) to fit several
    vocabularies from one pass.
    """
    tokenizer, remover = _stages(text, stop_words)
    top = (
        (term_statistics(df, text, stop_words) if statistics is None else statistics)
        .orderBy(F.desc(F.col("term") == ""), F.desc("tf"), "term").limit(max_features + 1).collect()
    )
    if len(top) < 2:
        raise ValueError("no terms: every text is empty or holds stop words only")
    n, top = top[0]["tf"], top[1:]
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in top], inputCol="tokens", outputCol="_tf")
    idf = Vectors.dense([math.log((1 + n) / (1 + r["df"])) + 1 for r in top])
    weigh = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_weighted")
    norm = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
    return PipelineModel([tokenizer, remover, counter, weigh, norm])


def vectorize(model: PipelineModel, df: DataFrame, text: str = "extracted_text") -> DataFrame:
    return model.transform(df.where(F.col(text).isNotNull())).drop("_raw", "tokens", "_tf", "_weighted")


def vectorize_all(models: dict[str, PipelineModel], df: DataFrame, text: str = "extracted_text") -> DataFrame:
    """One column of vectors for each model, under its name. The models have the same stop words,
    so each text is tokenized once for all of them, and as no vocabulary holds a stop word, none has
    to be taken out of the texts."""
    tokenizer = next(iter(models.values())).stages[0]
    rows = tokenizer.transform(df.where(F.col(text).isNotNull())).withColumnRenamed("_raw", "tokens")
    for name, model in models.items():
        for stage in model.stages[2:]:
            rows = stage.transform(rows)
        rows = rows.withColumnRenamed(model.stages[-1].getOutputCol(), name).drop("_tf", "_weighted")
    return rows.drop("tokens")


def terms_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary


def tfidf_weights(model: PipelineModel, df: DataFrame, key: str = "data_id", text: str = "extracted_text") -> DataFrame:
    """The vectors in long form: key, term, weight (non-zero weights only)."""
    terms = F.array(*[F.lit(t) for t in terms_of(model)])
    # The vectors are sparse: only the terms that a text holds are exploded.
    sparse = vectorize(model, df.select(key, text), text).select(key, F.unwrap_udt("features").alias("v"))
    long = sparse.select(key, F.inline_outer(F.arrays_zip("v.indices", "v.values")).alias("i", "weight"))
    return long.where("weight > 0").select(key, F.element_at(terms, F.col("i") + 1).alias("term"), "weight")
