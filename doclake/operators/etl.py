"""Extract documents without analytics, transform them, load results and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.functions import scalars as SC, text as TX
from doclake.operators import quality as Q
from doclake.session import discard, written
from doclake.sources.tables import TableStore


def join_files_processed(files: DataFrame, processed_data: DataFrame) -> DataFrame:
    """Extracted texts with the attributes of their file; the file bytes are never read."""
    return files.drop("content").join(
        processed_data.select("data_id", "file_id", "content_type", "extracted_text"), "file_id"
    )


def due_documents(files: DataFrame, processed_data: DataFrame, analytics_results: DataFrame,
                  batch_size: int | None = None) -> DataFrame:
    """Keys and file attributes of processed files' texts that have no analytics row yet."""
    columns = [c for c in ("file_id", "filename", "file_type", "metadata") if c in files.columns]
    pending = processed_data.select("data_id", "file_id").join(
        analytics_results.select("data_id"), "data_id", "left_anti"
    )
    due = files.where("processed").select(*columns).join(pending, "file_id")
    return due if batch_size is None else due.orderBy("data_id").limit(batch_size)


def with_texts(due: DataFrame, processed_data: DataFrame) -> DataFrame:
    return due.join(processed_data.select("data_id", "content_type", "extracted_text"), "data_id")


def extract_unanalyzed(files: DataFrame, processed_data: DataFrame, analytics_results: DataFrame,
                       batch_size: int | None = None) -> DataFrame:
    """Texts of processed files that have no analytics row yet.

    Which documents are due is decided on keys alone; the texts come in last, in one join.
    """
    return with_texts(due_documents(files, processed_data, analytics_results, batch_size), processed_data)


def etl_transform(docs: DataFrame, mode: str = "literal") -> DataFrame:
    """Quality checks, analytics and features of every document with a text."""
    text = "extracted_text"
    return TX.with_words(docs.where(F.col(text).isNotNull()), text).select(
        "data_id",
        "file_id",
        Q.check_array(text, words_col="_words", mode=mode).alias("quality"),
        TX.basic_analytics(text, "_words").alias("analytics"),
        TX.engineered_features(text, "_words").alias("features"),
    )


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def analytics_rows(transformed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per document for ``analytics_results``; the confidence is the sentiment."""
    a = F.col("analytics")
    return transformed.select(
        SC.stable_id("data_id", F.lit("basic_analytics")).alias("analysis_id"),
        "data_id",
        F.lit("basic_analytics").alias("analysis_type"),
        F.to_json(a).alias("results"),
        TX.insight_text(a["word_count"]).alias("insights"),
        a["sentiment_score"].alias("confidence_score"),
        _now(as_of).alias("created_date"),
    )


def quality_rows(transformed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per document and check for ``data_quality_metrics``."""
    return transformed.select("data_id", "file_id", F.inline_outer("quality")).select(
        SC.stable_id("data_id", "check_type").alias("metric_id"),
        "file_id",
        "check_type",
        "check_value",
        F.lit(None).cast("double").alias("threshold"),
        "status",
        _now(as_of).alias("check_date"),
    )


def document_features(transformed: DataFrame) -> DataFrame:
    return transformed.select("data_id", "features.*")


def etl_run(store: TableStore, batch_size: int | None = None, as_of: Column | None = None,
            processed_data: DataFrame | None = None) -> int:
    """Analyse what has no analytics yet and append the results; returns the document count.

    The metrics go first and the analytics last. Since extraction looks at the analytics,
    a run that dies in between is simply run again: ids depend on the document only, so
    metrics that were already written are recognised and not written twice.

    The steps are written, not cached: appending to a table makes Spark refresh every cached
    frame that reads it, and these read the analytics they are about to extend. It also
    tells the planner how many documents are due, so that a small batch is broadcast to the
    scan of the texts and only a large one shuffles them.
    """
    texts = store.read("processed_data") if processed_data is None else processed_data
    if batch_size is not None:
        # NULL texts are never analysed; a batch of nothing else would block all later ones.
        texts = texts.where(F.col("extracted_text").isNotNull())
    due = written(due_documents(store.read("files"), texts, store.read("analytics_results"), batch_size), "due")
    parts = [due]
    try:
        if due.isEmpty():
            return 0
        transformed = written(etl_transform(with_texts(due, texts)), "etl")
        parts.append(transformed)
        # Only metrics of this batch's files can repeat; a small batch finds them unshuffled.
        known = (
            store.read("data_quality_metrics").select("metric_id", "file_id")
            .join(due.select("file_id"), "file_id", "left_semi").select("metric_id")
        )
        store.append("data_quality_metrics", quality_rows(transformed, as_of).join(known, "metric_id", "left_anti"))
        store.append("analytics_results", analytics_rows(transformed, as_of))
        return transformed.count()
    finally:
        for part in parts:
            discard(part)
