import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from doclake.functions.text import ML_FEATURES
from doclake.operators import cluster, iforest, insights, quantile, sentiment, tfidf

TOPICS = ["apple banana cherry fruit", "engine wheel brake motor", "violin piano melody concert"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(90):
        words = [rng.choice(TOPICS[i % 3].split()) for _ in range(20)] + ["the", "and", f"noise{i}"]
        rows.append((f"d{i:03}", " ".join(words), i % 3))
    return spark.createDataFrame(rows, "data_id string, extracted_text string, topic int").cache()


def test_tfidf_against_plain_python(spark, docs):
    stop = ["the", "and"]
    texts = {r["data_id"]: [w for w in r["extracted_text"].split() if w not in stop] for r in docs.collect()}
    total = Counter(w for ws in texts.values() for w in ws)
    vocabulary = sorted(total, key=lambda w: (-total[w], w))[:15]
    df = Counter(w for ws in texts.values() for w in set(ws))
    model = tfidf.fit_tfidf(docs, max_features=15, stop_words=stop)
    assert tfidf.terms_of(model) == vocabulary
    got = {(r["data_id"], r["term"]): r["weight"] for r in tfidf.tfidf_weights(model, docs).collect()}
    for d, ws in texts.items():
        tf = Counter(w for w in ws if w in vocabulary)
        raw = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert math.isclose(got.pop((d, w)), v / norm)
    assert not got
    idf = {r["term"]: r for r in tfidf.term_idf(docs, stop_words=stop).collect()}
    assert idf["apple"]["df"] == df["apple"] and "the" not in idf


def test_tokens_follow_word_characters(spark):
    df = spark.createDataFrame([("a", "It's x_y é1 Ünï-code 42 a ①② don't")], "data_id string, extracted_text string")
    import re
    got = tfidf.tokens(df, stop_words=["none"]).first()["tokens"]
    assert got == re.findall(r"(?u)\b\w\w+\b", df.first()["extracted_text"].lower())


def test_no_terms(spark):
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(spark.createDataFrame([("a", "the and")], "data_id string, extracted_text string"))


def test_clusters_and_topics(docs):
    result = cluster.text_clustering(docs, n_clusters=3)
    labels = docs.join(result.assignments, "data_id").groupBy("topic").agg(F.count_distinct("prediction").alias("n"))
    assert [r["n"] for r in labels.collect()] == [1, 1, 1]
    assert [r["size"] for r in result.sizes().collect()] == [30, 30, 30]
    assert result.silhouette.first()[0] > 0.5 and result.n_clusters == 3
    terms = result.top_terms.where("rank <= 4").groupBy("cluster").agg(F.collect_set("term").alias("t")).collect()
    assert {frozenset(r["t"]) for r in terms} == {frozenset(t.split()) for t in TOPICS}
    again = cluster.text_clustering(docs, n_clusters=3, score=False).assignments
    assert again.exceptAll(result.assignments).count() == 0
    topics = cluster.topic_modeling(docs, 3)
    assert topics.top_terms.groupBy("cluster").count().collect()[0]["count"] == 15


def test_sentiment(spark, docs):
    trained = sentiment.sentiment_analysis(docs, label="topic", n_trees=20)
    both = trained.predictions.join(docs, "data_id")
    assert both.where("prediction = topic").count() == 90
    row = trained.predictions.first()
    assert len(row["probability"]) == 3 and math.isclose(sum(row["probability"]), 1)
    assert math.isclose(trained.importances.agg(F.sum("importance")).first()[0], 1)
    rules = sentiment.sentiment_analysis(docs)
    assert rules.model is None and rules.predictions.count() == 90
    untrainable = spark.createDataFrame([("a", "the", 1)], "data_id string, extracted_text string, y int")
    failed = sentiment.sentiment_analysis(untrainable, label="y")
    assert failed.model is None and "no terms" in failed.model_info


def test_exact_quantile(spark):
    rng = np.random.default_rng(3)
    samples = [rng.normal(size=1001), rng.integers(0, 4, 500).astype(float), np.array([5.0]), np.array([1.0, 2.0]),
               np.r_[np.zeros(99), 1e9], np.r_[rng.normal(size=300) * 1e-12 + 1, 1e6], np.ones(20)]
    for x in samples:
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        for q in (0.0, 0.1, 0.37, 0.5, 1.0):
            assert math.isclose(quantile.exact_quantile(df, "x", q), float(np.percentile(x, q * 100)), rel_tol=1e-12, abs_tol=1e-15)
    assert quantile.exact_quantile(df.where("false"), "x", 0.5) is None


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(7)
    normal = rng.normal(10, 1, (500, 8))
    odd = rng.normal(60, 5, (10, 8))
    rows = [(f"n{i}", *map(float, v)) for i, v in enumerate(normal)] + [(f"o{i}", *map(float, v)) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "data_id string, " + ", ".join(f"{f} double" for f in ML_FEATURES)).cache()


def test_isolation_forest(features):
    forest, labelled = iforest.fit(features)
    flagged = {r["data_id"] for r in labelled.where("anomaly = -1").collect()}
    assert {f"o{i}" for i in range(10)} <= flagged and len(flagged) == 51
    assert forest.nodes["tree"].nunique() == 100 and forest.max_depth == 8
    assert len(forest.nodes) <= 100 * (2 * 256 - 1)
    _, again = iforest.fit(features.repartition(7))
    assert again.select("data_id", "anomaly").exceptAll(labelled.select("data_id", "anomaly")).count() == 0
    count = iforest.anomaly_count(labelled).first()
    assert (count["anomalies"], count["total"]) == (51, 510)


def test_samples_per_tree(spark, features):
    for n, size in ((510, 256), (510, 20), (510, 510)):
        sample = iforest.sample_trees(features, "data_id", n, 100, size, 42)
        per_tree = sample.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("data_id").alias("d")).collect()
        assert len(per_tree) == 100 and all(r["n"] == r["d"] == size for r in per_tree)
    few = iforest.sample_trees(features.limit(5), "data_id", 5, 10, 5, 1)
    assert few.count() == 50


def test_forest_too_large_to_send(features):
    forest, _ = iforest.fit(features, n_trees=2, max_samples=16)
    forest.nodes = pd.concat([forest.nodes] * (iforest.MAX_NODES // len(forest.nodes) + 1))
    with pytest.raises(ValueError):
        forest.scores(features)


def test_path_lengths(features):
    """Scores equal a walk down each tree, row by row."""
    forest, _ = iforest.fit(features, n_trees=5, max_samples=64)
    rows = forest.scores(features).limit(20).collect()
    trees = {t: g.set_index("node") for t, g in forest.nodes.groupby("tree")}
    for row in rows:
        total = 0.0
        for tree in trees.values():
            node = tree.loc[0]
            while node["feature"] >= 0:
                x = row[ML_FEATURES[int(node["feature"])]]
                node = tree.loc[int(node["left"] if x <= node["threshold"] else node["right"])]
            total += node["path"]
        assert math.isclose(row["raw_score"], -(2 ** -(total / 5 / iforest.expected_path(64))))


def reads(df, text="extracted_text"):
    """A frame whose texts count how often they are read."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def seen(t):
        n.add(1)
        return t

    return df.withColumn(text, F.udf(seen, "string").asNondeterministic()(text)), n


def test_insights_read_each_text_three_times(docs):
    """Once for features, sentiment and counts, once for both vocabularies, once for both kinds of vectors."""
    counted, n = reads(docs.withColumn("extracted_text", F.concat("extracted_text", F.lit(" " + "padding " * 10))))
    found = insights.ml_insights(counted)
    for name in ("clustering", "topic_modeling"):
        assert found[name].assignments.count() == 90
    assert found["sentiment_analysis"].predictions.count() == found["anomaly_detection"].count() == 90
    assert n.value <= 3 * 90


def test_clusters_and_topics_together(docs):
    """Both are what each function gives alone, as bits."""
    clusters, topics = cluster.clusters_and_topics(docs, 3, 3)
    for got, want in ((clusters, cluster.text_clustering(docs, 3)), (topics, cluster.topic_modeling(docs, 3))):
        assert sorted(map(tuple, got.assignments.collect())) == sorted(map(tuple, want.assignments.collect()))
        assert got.top_terms.collect() == want.top_terms.collect()
        assert got.silhouette.collect() == want.silhouette.collect() and got.model_info == want.model_info
        assert tfidf.terms_of(got.model) == tfidf.terms_of(want.model)


def test_insights_and_storage(spark, docs, folder):
    long = docs.withColumn("extracted_text", F.concat("extracted_text", F.lit(" " + "padding " * 10)))
    found = insights.ml_insights(long)
    assert set(found) == {"clustering", "topic_modeling", "sentiment_analysis", "anomaly_detection", "anomaly_model"}
    assert found["clustering"].n_clusters == 3
    assert insights.ml_insights(long.limit(3)) == {}
    models = {"clustering": found["clustering"].model, "anomaly": found["anomaly_model"]}
    insights.save_models(spark, models, folder + "/models")
    loaded = insights.load_models(spark, folder + "/models")
    vectors = [m.transform(long).select("data_id", "prediction", vector_to_array("features").alias("v"))
               for m in (models["clustering"], loaded["clustering"])]
    assert vectors[0].exceptAll(vectors[1]).count() == 0
    assert loaded["anomaly"].offset == models["anomaly"].offset
    assert insights.ml_sample(long, 5).count() == 5 and insights.ml_sample(long, None).count() == 90
