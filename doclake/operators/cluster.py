"""K-means over TF-IDF vectors: text clusters and topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, SparkSession, functions as F

from doclake.operators import tfidf
from doclake.session import written

TOPIC_FEATURES, TOPIC_TERMS = 500, 15


@dataclass
class Clustering:
    model: PipelineModel
    n_clusters: int
    assignments: DataFrame  # key, prediction
    silhouette: DataFrame   # one row: silhouette_sq
    top_terms: DataFrame    # cluster, rank, term, weight
    model_info: str

    def sizes(self) -> DataFrame:
        return cluster_sizes(self.assignments)


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("prediction").agg(F.count("*").alias("size"))


def top_terms(spark: SparkSession, model: PipelineModel, k: int) -> DataFrame:
    """The ``k`` heaviest terms of every cluster centre, best first.

    Centres are part of the model: clusters x vocabulary numbers, whatever the data size.
    """
    terms = tfidf.terms_of(model)
    centers = next(s for s in model.stages if isinstance(s, KMeansModel)).clusterCenters()
    rows = [
        (cluster, rank + 1, terms[i], float(center[i]))
        for cluster, center in enumerate(centers)
        for rank, i in enumerate(sorted(range(len(terms)), key=lambda i: (-center[i], terms[i]))[:k])
    ]
    return spark.createDataFrame(rows, "cluster int, rank int, term string, weight double")


def silhouette(predictions: DataFrame) -> float:
    """Mean silhouette on squared Euclidean distance, linear in the number of rows."""
    return ClusteringEvaluator(
        featuresCol="features", predictionCol="prediction", metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(predictions)


def text_clustering(df: DataFrame, n_clusters: int = 5, max_features: int = 1000, n_terms: int = 10,
                    text: str = "extracted_text", key: str = "data_id", seed: int = 42,
                    stop_words: list[str] | None = None, score: bool = True,
                    statistics: DataFrame | None = None) -> Clustering:
    """K-means over the texts. They are read twice: for the vocabulary (not if ``statistics``
    are given) and for the vectors; iterations, score and assignments read the written vectors."""
    vectorizer = tfidf.fit_tfidf(df, text, max_features, stop_words, statistics=statistics)
    table = written(tfidf.vectorize(vectorizer, df.select(key, text), text).select(key, "features"), "vectors")
    return _clustering(vectorizer, table, n_clusters, n_terms, key, seed, score)


def _clustering(vectorizer: PipelineModel, table: DataFrame, n_clusters: int, n_terms: int, key: str, seed: int,
                score: bool) -> Clustering:
    spark = table.sparkSession
    vectors = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kmeans = KMeans(k=n_clusters, seed=seed, featuresCol="features", predictionCol="prediction").fit(vectors)
        value = None
        if score:
            predicted = kmeans.transform(vectors)
            found = predicted.select("prediction").distinct().count()
            value = silhouette(predicted) if found > 1 else None
    finally:
        vectors.unpersist()
    model = PipelineModel([*vectorizer.stages, kmeans])
    return Clustering(
        model=model,
        n_clusters=n_clusters,
        assignments=kmeans.transform(table).select(key, "prediction"),
        silhouette=spark.createDataFrame([(value,)], "silhouette_sq double"),
        top_terms=top_terms(spark, model, n_terms),
        model_info=f"KMeans with {n_clusters} clusters",
    )


def topic_modeling(df: DataFrame, n_topics: int = 5, text: str = "extracted_text", key: str = "data_id",
                   seed: int = 42, stop_words: list[str] | None = None,
                   statistics: DataFrame | None = None) -> Clustering:
    """Topics are clusters over a vocabulary of 500 terms, described by 15 terms each."""
    return _as_topics(text_clustering(
        df, n_topics, TOPIC_FEATURES, TOPIC_TERMS, text, key, seed, stop_words, score=False, statistics=statistics))


def _as_topics(result: Clustering) -> Clustering:
    result.model_info = f"Topic modeling with {result.n_clusters} topics"
    return result


def clusters_and_topics(df: DataFrame, n_clusters: int, n_topics: int, text: str = "extracted_text", key: str = "data_id",
                        seed: int = 42, stop_words: list[str] | None = None) -> tuple[Clustering, Clustering]:
    """What :func:`text_clustering` and :func:`topic_modeling` give, from two readings of the texts
    instead of four: one for both vocabularies, one for the vectors over each of them."""
    terms = written(tfidf.term_statistics(df, text, stop_words), "terms")
    models = {name: tfidf.fit_tfidf(df, text, n, stop_words, statistics=terms)
              for name, n in (("clusters", 1000), ("topics", TOPIC_FEATURES))}
    table = written(tfidf.vectorize_all(models, df.select(F.col(key).alias("key"), text), text).select("key", *models), "vectors")

    def found(name: str, n: int, n_terms: int, score: bool) -> Clustering:
        vectors = table.select(F.col("key").alias(key), F.col(name).alias("features"))
        return _clustering(models[name], vectors, n, n_terms, key, seed, score)

    return found("clusters", n_clusters, 10, True), _as_topics(found("topics", n_topics, TOPIC_TERMS, False))
