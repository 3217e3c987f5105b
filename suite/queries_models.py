"""TF-IDF with checking SQL; clusters, topics, forests as rows-only queries."""

import uuid

from pyspark.sql import Window, functions as F

from doclake.functions import text as TX
from doclake.operators import cluster, iforest, insights, sentiment, tfidf
from doclake.session import shared_folder, written
from suite.catalog import Tables, query, rounded, sql_list

T = "extracted_text"
# A short stop list, passed to both sides.
STOP = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "les", "des", "und", "der", "los"]
TOKENS = f"""toks AS (SELECT data_id, list_filter(regexp_extract_all(lower({T}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
 lambda x: NOT list_contains({sql_list(STOP)}, x)) AS w FROM processed_data WHERE {T} IS NOT NULL)"""


def docs(t: Tables):
    return t.processed_data.where(F.col(T).isNotNull()).select("data_id", T)


@query("tfidf", f"""WITH {TOKENS}, terms AS (SELECT unnest(list_distinct(w)) AS term FROM toks)
SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM toks)) / (1 + count(*))) + 1, 6) AS idf
FROM terms GROUP BY term""")
def _(t):
    return rounded(tfidf.term_idf(docs(t), min_df=1, stop_words=STOP), "idf")


VOCABULARY = """vocab AS (SELECT term, count(*) AS count FROM (SELECT unnest(w) AS term FROM toks) GROUP BY term
 ORDER BY count(*) DESC, term LIMIT {n})"""


@query("vocabulary", f"WITH {TOKENS}, {VOCABULARY.format(n=1000)} SELECT * FROM vocab")
def _(t):
    return tfidf.vocabulary(docs(t), stop_words=STOP)


@query("tfidf_weights", f"""WITH {TOKENS}, {VOCABULARY.format(n=500)},
tf AS (SELECT data_id, term, count(*) AS tf FROM (SELECT data_id, unnest(w) AS term FROM toks)
 WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
weighted AS (SELECT data_id, term, tf * (ln((1 + (SELECT count(*) FROM toks)) / (1 + d.df)) + 1) AS x
 FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) d USING (term))
SELECT data_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY data_id)), 6) AS weight FROM weighted""")
def _(t):
    model = tfidf.fit_tfidf(docs(t), max_features=500, stop_words=STOP)
    return rounded(tfidf.tfidf_weights(model, docs(t)), "weight")


def clustering(t: Tables):
    return cluster.text_clustering(docs(t), n_clusters=5)


@query("text_clustering")
def _(t):
    return clustering(t).assignments


@query("silhouette")
def _(t):
    return clustering(t).silhouette


@query("cluster_sizes")
def _(t):
    return cluster.text_clustering(docs(t), n_clusters=5, score=False).sizes()


@query("top_terms")
def _(t):
    return cluster.text_clustering(docs(t), n_clusters=5, score=False).top_terms


@query("topic_modeling")
def _(t):
    return cluster.topic_modeling(docs(t)).top_terms


def labelled(t: Tables):
    labels = t.labels.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("data_id"), "quality")
    return docs(t).join(labels, "data_id")


@query("sentiment_classifier")
def _(t):
    return sentiment.sentiment_analysis(labelled(t), label="quality").predictions


@query("feature_importance")
def _(t):
    return sentiment.sentiment_analysis(labelled(t), label="quality").importances


@query("anomaly_detection")
def _(t):
    return iforest.anomaly_detection(TX.ml_features(t.processed_data))


@query("anomaly_count")
def _(t):
    return iforest.anomaly_count(iforest.anomaly_detection(TX.ml_features(t.processed_data)))


# What must hold for any trained model, over all its rows, whatever the numbers of its labels.


@query("clustering_invariants", f"""SELECT count(*) AS texts, count(DISTINCT data_id) AS keys, count(*) AS in_range, count(*) AS in_sizes,
 50 AS top_terms, TRUE AS silhouette_in_range FROM processed_data WHERE {T} IS NOT NULL""")
def _(t):
    found = clustering(t)
    total = F.count("*")
    return found.assignments.agg(
        total.alias("texts"), F.count_distinct("data_id").alias("keys"), F.count_if(F.col("prediction").between(0, 4)).alias("in_range"),
    ).select(
        "*", found.sizes().agg(F.sum("size")).scalar().alias("in_sizes"), found.top_terms.agg(total.cast("int")).scalar().alias("top_terms"),
        found.silhouette.select(F.col("silhouette_sq").between(-1, 1)).scalar().alias("silhouette_in_range"))


@query("sentiment_invariants", f"""SELECT count(*) AS texts, count(*) AS known_labels, count(*) AS summing_to_one, 1.0::DOUBLE AS importance
FROM processed_data p JOIN labels l ON p.data_id = concat('p', CAST(l.doc_id AS VARCHAR)) WHERE {T} IS NOT NULL AND quality IS NOT NULL""")
def _(t):
    found = sentiment.sentiment_analysis(labelled(t), label="quality")
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    return found.predictions.agg(
        F.count("*").alias("texts"), F.count_if(F.col("prediction").isin(0, 1)).alias("known_labels"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("summing_to_one"),
    ).select("*", found.importances.agg(F.round(F.sum("importance"), 6)).scalar().alias("importance"))


# A row is flagged below the 0.1-quantile of the scores: at most a tenth of the steps between rows, and one.
@query("anomaly_invariants", f"""SELECT count(*) AS total, count(DISTINCT data_id) AS keys, TRUE AS share_holds, TRUE AS sign_agrees
FROM processed_data WHERE {T} IS NOT NULL""")
def _(t):
    flagged = F.count_if(F.col("anomaly") == -1)
    return iforest.anomaly_detection(TX.ml_features(t.processed_data)).agg(
        F.count("*").alias("total"), F.count_distinct("data_id").alias("keys"),
        (flagged <= F.floor((F.count("*") - 1) * 0.1) + 1).alias("share_holds"),
        F.every((F.col("anomaly") == -1) == (F.col("anomaly_score") < 0)).alias("sign_agrees"))


# Results worked out a second time, in another way, from the model's own numbers.


@query("clustering_checked", f"""SELECT count(*) AS texts, count(*) AS nearest, count(*) AS counted, TRUE AS silhouette_agrees,
 50 AS heaviest FROM processed_data WHERE {T} IS NOT NULL""")
def _(t):
    """Every text is in the cluster of its nearest centre; sizes, silhouette and top terms follow from centres and vectors."""
    found = clustering(t)
    centres = [[float(x) for x in c] for c in found.model.stages[-1].clusterCenters()]
    assigned = found.model.transform(docs(t)).select("data_id", F.unwrap_udt("features").alias("v")).join(found.assignments, "data_id")
    # Vectors are sparse: only the terms that a text holds are kept, and their squares' sum.
    assigned = assigned.select("prediction", F.col("v.indices").alias("i"), F.col("v.values").alias("x"))
    assigned = written(assigned.withColumn("q", F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)), "assigned")

    def dot(c: list[float]):
        listed = F.split(F.lit(",".join(map(repr, c))), ",").cast("array<double>")  # one literal, not one for each number
        return F.aggregate(F.zip_with("i", "x", lambda i, x: F.get(listed, i) * x), F.lit(0.0), lambda a, x: a + x)

    distances = F.array(*[F.col("q") - dot(c) * 2 + sum(a * a for a in c) for c in centres])
    near = assigned.select("prediction", distances.alias("d")).select((F.get("d", F.col("prediction")) <= F.array_min("d") + 1e-9).alias("near"))

    # The mean squared distance of x to the rows of a cluster is |x|^2 + sum|y|^2 / n - 2 x . sum(y) / n.
    sums = assigned.select("prediction", F.inline(F.arrays_zip("i", "x"))).groupBy("prediction", "i").agg(F.sum("x").alias("x"))
    by_cluster = {r["prediction"]: (r["n"], r["q"]) for r in assigned.groupBy("prediction").agg(F.count("*").alias("n"), F.sum("q").alias("q")).collect()}
    total = {k: [0.0] * len(centres[0]) for k in by_cluster}
    for r in sums.collect():  # clusters x vocabulary numbers
        total[r["prediction"]][r["i"]] = r["x"]
    means = assigned.select("prediction", *[(F.col("q") + q / n - dot(total[k]) * (2 / n)).alias(f"m{k}") for k, (n, q) in by_cluster.items()])

    own, other = F.lit(None).cast("double"), []
    for k, (n, _) in by_cluster.items():
        mine = F.col("prediction") == k
        own = F.when(mine, F.col(f"m{k}") * (n / (n - 1)) if n > 1 else F.lit(None)).otherwise(own)
        other.append(F.when(~mine, F.col(f"m{k}")))
    scored = means.select(own.alias("a"), F.least(*other).alias("b"))
    value = scored.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("s"))

    terms = tfidf.terms_of(found.model)
    ranked = [[w for w, _ in sorted(((c[i], terms[i]) for i in range(len(terms))), key=lambda p: (-p[0], p[1]))[:10]] for c in centres]
    heaviest = F.count_if(F.abs(F.col("weight") - F.get(F.get(F.lit(ranked), F.col("cluster")), F.col("rank") - 1)) < 1e-12)
    counted = found.sizes().join(assigned.groupBy("prediction").agg(F.count("*").alias("n")), "prediction").where("size = n").agg(F.sum("size"))
    return near.agg(F.count("*").alias("texts"), F.count_if("near").alias("nearest")).select(
        "*", counted.scalar().alias("counted"),
        (F.abs(value.scalar() - found.silhouette.select("silhouette_sq").scalar()) < 1e-6).alias("silhouette_agrees"),
        found.top_terms.agg(heaviest.cast("int")).scalar().alias("heaviest"))


@query("importance_checked", f"""SELECT count(*) AS texts, count(*) AS most_likely, TRUE AS importances_agree
FROM processed_data p JOIN labels l ON p.data_id = concat('p', CAST(l.doc_id AS VARCHAR)) WHERE {T} IS NOT NULL AND quality IS NOT NULL""")
def _(t):
    """Predictions are the more likely class; a term's importance is its share of the impurity its splits take off, tree by tree."""
    found = sentiment.sentiment_analysis(labelled(t), label="quality")
    forest = next(s for s in found.model.stages if hasattr(s, "featureImportances"))
    folder = f"{shared_folder(t.spark)}/doclake/forest-{uuid.uuid4().hex}"
    forest.save(folder)
    nodes = t.spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").where("leftChild >= 0")
    gains = nodes.groupBy("treeID", F.col("split.featureIndex").alias("i")).agg(F.sum(F.col("gain") * F.col("rawCount")).alias("g"))
    gains = gains.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("treeID")))  # at most a tree's features
    gains = gains.groupBy("i").agg(F.sum("g").alias("g"))
    shares = {r["i"]: r["g"] for r in gains.collect()}  # one number per term of the vocabulary
    terms = tfidf.terms_of(found.model)
    mine = t.spark.createDataFrame([(terms[i], g / sum(shares.values())) for i, g in shares.items()], "term string, share double")
    agree = found.importances.join(mine, "term", "left").agg(
        F.every(F.abs(F.col("importance") - F.coalesce("share", F.lit(0.0))) < 1e-6)).scalar()
    likely = F.get("probability", F.col("prediction").cast("int")) >= F.array_max("probability")
    return found.predictions.agg(F.count("*").alias("texts"), F.count_if(likely).alias("most_likely")).withColumn("importances_agree", agree)


@query("anomaly_checked", f"""SELECT count(*) AS total, TRUE AS below_quantile FROM processed_data WHERE {T} IS NOT NULL""")
def _(t):
    """The flagged rows are those below the 0.1-quantile of the scores, by the engine's own exact percentile."""
    rows = written(iforest.anomaly_detection(TX.ml_features(t.processed_data)), "flagged")
    # Scores are shifted by the quantile, so it is at zero now.
    quantile = rows.agg(F.percentile("anomaly_score", F.lit(0.1))).scalar()
    counted = rows.where(F.col("anomaly_score") < quantile - 1e-12).agg(F.count("*")).scalar()
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("anomaly") == -1).alias("flagged")).select(
        "total", ((F.abs(quantile) < 1e-9) & (F.abs(F.col("flagged") - counted) <= 0)).alias("below_quantile"))


@query("saved_models", f"""SELECT count(*) AS texts, count(*) AS same_cluster, count(*) AS same_anomaly, 2 AS models
FROM processed_data WHERE {T} IS NOT NULL""")
def _(t):
    """Models that were saved and loaded again say the same of every text."""
    found = cluster.text_clustering(docs(t), n_clusters=5, score=False)
    rows = written(TX.ml_features(t.processed_data), "features")
    forest, flagged = iforest.fit(rows)
    folder = f"{shared_folder(t.spark)}/doclake/models-{uuid.uuid4().hex}"
    insights.save_models(t.spark, {"clusters": found.model, "anomalies": forest}, folder)
    again = insights.load_models(t.spark, folder)
    clusters = again["clusters"].transform(docs(t)).select("data_id", F.col("prediction").alias("p")).join(found.assignments, "data_id")
    anomalies = again["anomalies"].predict(rows).select("data_id", F.col("anomaly").alias("a")).join(flagged.select("data_id", "anomaly"), "data_id")
    return clusters.join(anomalies, "data_id").agg(
        F.count("*").alias("texts"), F.count_if(F.col("p") == F.col("prediction")).alias("same_cluster"),
        F.count_if(F.col("a") == F.col("anomaly")).alias("same_anomaly"), F.lit(len(again)).alias("models"))


@query("ml_insights")
def _(t):
    found = insights.ml_insights(docs(t))
    clusters, topics = found["clustering"].assignments, found["topic_modeling"].assignments
    return (
        clusters.withColumnRenamed("prediction", "cluster")
        .join(topics.withColumnRenamed("prediction", "topic"), "data_id", "full")
        .join(found["sentiment_analysis"].predictions, "data_id", "full")
        .join(found["anomaly_detection"].select("data_id", "anomaly"), "data_id", "full")
    )
