"""Sentiment of texts: by rules, or by a random forest when there are labels."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from doclake.functions import text as TX
from doclake.operators import tfidf
from doclake.session import written


RULE_BASED = "Rule-based sentiment analysis"


@dataclass
class Sentiment:
    predictions: DataFrame
    importances: DataFrame | None
    model: PipelineModel | None
    model_info: str


def rule_based_sentiment(df: DataFrame, text: str = "extracted_text", key: str = "data_id") -> DataFrame:
    """key, sentiment in [-1, 1], confidence in [0, 1]."""
    return (
        TX.with_words(df.select(key, text).where(F.col(text).isNotNull()), text)
        .select(key, TX.rule_hits("_words").alias("_hits"))
        .select(key, TX.rule_sentiment(text, hits_col="_hits").alias("s"))
        .select(key, "s.sentiment", "s.confidence")
    )


def _train(df, label, text, key, n_trees, max_depth, max_features, seed, stop_words) -> Sentiment:
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull()).select(key, text, F.col(label).cast("string").alias("_label"))
    vectorizer = tfidf.fit_tfidf(known, text, max_features, stop_words)
    # Training and predictions read the vectors, not the texts again.
    table = written(tfidf.vectorize(vectorizer, known, text).select(key, "_label", "features"), "vectors")
    vectors = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        indexer = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc").fit(vectors)
        forest = RandomForestClassifier(
            featuresCol="features", labelCol="_index", numTrees=n_trees, maxDepth=max_depth, seed=seed,
            predictionCol="_predicted", maxMemoryInMB=512,
        ).fit(indexer.transform(vectors))
    finally:
        vectors.unpersist()
    back = IndexToString(inputCol="_predicted", outputCol="prediction", labels=indexer.labels)
    model = PipelineModel([*vectorizer.stages, forest, back])
    importance = forest.featureImportances.toArray()
    rows = [(t, float(v)) for t, v in zip(tfidf.terms_of(vectorizer), importance)]
    kind = df.schema[label].dataType
    predictions = back.transform(forest.transform(table)).select(
        key, F.col("prediction").cast(kind).alias("prediction"), vector_to_array("probability").alias("probability")
    )
    return Sentiment(
        predictions=predictions,
        importances=spark.createDataFrame(rows, "term string, importance double"),
        model=model,
        model_info="Random Forest for sentiment analysis",
    )


def sentiment_analysis(df: DataFrame, label: str | None = None, text: str = "extracted_text", key: str = "data_id",
                       n_trees: int = 100, max_depth: int = 10, max_features: int = 1000, seed: int = 42,
                       stop_words: list[str] | None = None) -> Sentiment:
    """Random forest on TF-IDF when ``label`` names a column; rules otherwise.

    The rules also answer when training fails for any reason; ``model_info`` then names it.
    """
    info = RULE_BASED
    if label is not None:
        try:
            return _train(df, label, text, key, n_trees, max_depth, max_features, seed, stop_words)
        except (ValueError, PySparkException, Py4JError) as e:
            info = f"{info} (training failed: {str(e).splitlines()[0]})"
    return Sentiment(rule_based_sentiment(df, text, key), None, None, info)
