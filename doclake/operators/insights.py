"""All models over one document frame, and their storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from doclake.functions import text as TX
from doclake.operators import cluster, iforest, sentiment
from doclake.session import written


def ml_sample(processed_data: DataFrame, limit: int | None = None, text: str = "extracted_text") -> DataFrame:
    """Texts of more than 100 bytes with their counts; all of them unless ``limit`` is given."""
    rows = TX.filter_min_bytes(processed_data, text).select(
        "data_id", text, TX.word_count(text).alias("word_count"), TX.char_count(text).alias("char_count")
    )
    return rows if limit is None else rows.orderBy("data_id").limit(limit)


def ml_insights(docs: DataFrame, text: str = "extracted_text", key: str = "data_id", seed: int = 42) -> dict:
    """Clusters, topics and sentiment from 5 valid texts on; anomalies from 10 rows on."""
    valid = TX.valid_texts(docs, text)
    # One pass over the texts gives counts, sentiment and features; two more give clusters and topics.
    measures = written(TX.ml_measures(docs, text, (key,)), "measures")
    counts = measures.agg(F.count_if("valid").alias("valid"), F.count("*").alias("rows")).first()
    found: dict = {}
    if counts["valid"] >= 5:
        found["clustering"], found["topic_modeling"] = cluster.clusters_and_topics(valid, 3, 3, text, key, seed)
        ruled = measures.where("valid").select(key, "sentiment", "confidence")
        found["sentiment_analysis"] = sentiment.Sentiment(ruled, None, None, sentiment.RULE_BASED)
    if counts["rows"] >= 10:
        forest, labelled = iforest.fit(measures, key=key, seed=seed)
        found["anomaly_detection"] = labelled
        found["anomaly_model"] = forest
    return found


def save_models(spark: SparkSession, models: dict[str, object], path: str) -> None:
    """Store pipeline models and forests under one folder, with a list of what is there."""
    kinds = []
    for name, model in models.items():
        if isinstance(model, iforest.IsolationForest):
            model.save(spark, f"{path}/{name}")
            kinds.append((name, "isolation_forest"))
        else:
            model.write().overwrite().save(f"{path}/{name}")
            kinds.append((name, "pipeline"))
    spark.createDataFrame(kinds, "name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_models")


def load_models(spark: SparkSession, path: str) -> dict[str, object]:
    loaders = {
        "isolation_forest": lambda p: iforest.IsolationForest.load(spark, p),
        "pipeline": PipelineModel.load,
    }
    listed = spark.read.parquet(f"{path}/_models").collect()
    return {r["name"]: loaders[r["kind"]](f"{path}/{r['name']}") for r in listed}
