"""The reporting questions over the four tables.

``as_of`` stands for the current time wherever a report looks back from now, so that a
report can be repeated for any moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake import schema
from doclake.functions import scalars as SC


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def recent(df: DataFrame, ts: str, days: int | None = None, hours: int | None = None,
           as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` (bound included) or the last ``hours`` (bound excluded).

    Of a table stored by the day of ``ts`` only the folders of these days are read, and one
    more, since the table may have been written in another time zone.
    """
    if days is not None:
        bound = _now(as_of) - F.make_dt_interval(F.lit(days))
        rows = df.where(F.col(ts) >= bound)
    else:
        bound = _now(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
        rows = df.where(F.col(ts) > bound)
    if schema.DAY in df.columns and ts in schema.DAY_OF.values():
        rows = rows.where(F.col(schema.DAY).isNull() | (F.col(schema.DAY) >= F.date_sub(F.to_date(bound), 1)))
    return rows


# ----------------------------------------------------------------------- filters, lists


def processed_files(files: DataFrame, processed: bool = True) -> DataFrame:
    return files.where(F.col("processed") if processed else ~F.col("processed"))


def unprocessed_files(files: DataFrame) -> DataFrame:
    return processed_files(files, False).select("file_id", "filename")


def not_good(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("status") != "good")


def quality_issues(metrics: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """The newest checks with a bad status and the name of their file."""
    return (
        not_good(metrics)
        .join(files.select("file_id", "filename"), "file_id")
        .orderBy(F.desc("check_date"), "metric_id")
        .limit(limit)
        .select("check_type", "status", "check_value", "check_date", "filename")
    )


# ------------------------------------------------------------------------------ counts


def count_rows(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def files_scan(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.count_if("processed").alias("processed_files"))


def file_type_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "file_type")


def file_type_stats(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("file_type")
        .agg(F.count("*").alias("count"), F.avg("file_size").alias("avg_size"))
        .orderBy(F.desc("count"), "file_type")
    )


def analyzed_files(files: DataFrame, processed_data: DataFrame, analytics_results: DataFrame) -> DataFrame:
    """Number of distinct files that reached the analytics, by semi-joins (no fan-out)."""
    analysed = processed_data.select("file_id", "data_id").join(
        analytics_results.select("data_id"), "data_id", "left_semi"
    )
    return files.select("file_id").join(analysed.select("file_id"), "file_id", "left_semi").agg(
        F.count_distinct("file_id").alias("analyzed_files")
    )


def _rate(part, total) -> Column:
    part, total = F.col(part), F.col(total)
    return F.when(total > 0, part / F.greatest(total, F.lit(1)) * 100).otherwise(0.0)


def processing_stats(files: DataFrame, processed_data: DataFrame, analytics_results: DataFrame) -> DataFrame:
    """One row: total, processed and analysed files and the processing rate."""
    return files_scan(files).select(
        "total_files", "processed_files",
        analyzed_files(files, processed_data, analytics_results).scalar().alias("analyzed_files"),
        _rate("processed_files", "total_files").alias("processing_rate"),
    )


def pipeline_completion(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("total_files"),
        F.sum(F.col("processed").cast("int")).alias("processed_files"),
        (F.avg(F.when(F.col("processed"), 1).otherwise(0)) * 100).alias("completion_rate"),
    )


# ----------------------------------------------------------------------------- quality


def quality_overview(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("check_type", "status").agg(F.count("*").alias("count"))


def quality_overview_nested(metrics: DataFrame) -> DataFrame:
    """Per check a map status -> count. The lists hold one entry per distinct status."""
    counted = quality_overview(metrics).withColumn("status", F.coalesce("status", F.lit("unknown")))
    return counted.groupBy("check_type").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("statuses")
    )


def quality_overview_long(nested: DataFrame) -> DataFrame:
    return nested.select("check_type", F.explode("statuses").alias("status", "count"))


def _score() -> list[Column]:
    good = F.count_if(F.coalesce(F.col("status") == "good", F.lit(False)))
    total = F.count("*")
    return [
        total.alias("total_checks"),
        good.alias("passed_checks"),
        F.when(total > 0, good / F.greatest(total, F.lit(1)) * 100).otherwise(0.0).alias("quality_score"),
    ]


def quality_score_overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*_score())


def quality_score_by_check(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("check_type").agg(*_score())


def quality_band(scores: DataFrame, target: float = 90.0) -> DataFrame:
    """Colour band of each score, and whether it reaches the target."""
    s = F.col("quality_score")
    return scores.withColumn(
        "band", F.when(s < 50, "red").when(s < 80, "yellow").otherwise("green")
    ).withColumn("meets_target", s >= target)


# --------------------------------------------------------------------------- analytics


def result_number(analytics_results: DataFrame, field: str) -> Column:
    """A number of the analysis, by its path where the table has the parsed results, else from the JSON text."""
    if "parsed_results" in analytics_results.columns:
        return F.try_variant_get("parsed_results", f"$.{field}", "double")
    return SC.json_field("results", field)


def insight_averages(analytics_results: DataFrame) -> DataFrame:
    return analytics_results.agg(
        F.avg(result_number(analytics_results, "word_count")).alias("avg_word_count"),
        F.avg(result_number(analytics_results, "sentiment_score")).alias("avg_sentiment"),
        F.avg("confidence_score").alias("avg_confidence"),
    )


def _per_day(df: DataFrame, ts: str, day: str, count: str) -> DataFrame:
    return df.groupBy(SC.to_day(ts).alias(day)).agg(F.count("*").alias(count))


def recent_activity(analytics_results: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    rows = recent(analytics_results, "created_date", days=days, as_of=as_of)
    return _per_day(rows, "created_date", "date", "count").orderBy(F.desc("date"))


def recent_runs(analytics_results: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    rows = recent(analytics_results, "created_date", days=days, as_of=as_of)
    return _per_day(rows, "created_date", "run_date", "records_processed").orderBy(F.desc("run_date"))


def upload_timeline(files: DataFrame, as_of: Column | None = None, days: int = 30) -> DataFrame:
    rows = recent(files, "upload_date", days=days, as_of=as_of)
    return _per_day(rows, "upload_date", "date", "uploads").orderBy("date")


def new_rows(df: DataFrame, ts: str, name: str, hours: int = 1, as_of: Column | None = None) -> DataFrame:
    return count_rows(recent(df, ts, hours=hours, as_of=as_of), name)


def analytics_metrics(analytics_results: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Averages, all analyses, and the number of active days in the last week."""
    day = F.when(
        F.col("created_date") >= _now(as_of) - F.make_dt_interval(F.lit(7)), SC.to_day("created_date")
    )
    return analytics_results.agg(
        F.avg(result_number(analytics_results, "word_count")).alias("avg_word_count"),
        F.avg(result_number(analytics_results, "sentiment_score")).alias("avg_sentiment"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.count("*").alias("total_analyses"),
        F.size(F.collect_set(day)).cast("bigint").alias("active_days"),
    )


def sentiment_summary(sentiments: DataFrame) -> DataFrame:
    return sentiments.agg(
        F.avg("sentiment").alias("avg_sentiment"), F.avg("confidence").alias("avg_confidence")
    )


def sentiment_histogram(sentiments: DataFrame, bins: int = 20) -> DataFrame:
    """Counts per bin of [-1, 1]; the upper end belongs to the last bin."""
    s = F.col("sentiment")
    bin_ = F.least(F.floor((s + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    return sentiments.where(s.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("count"))


def upload_summary(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("extract_status").agg(F.count("*").alias("count"))


# -------------------------------------------------------------------------- composites


def summary_report(files: DataFrame, metrics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row: when, number of files, processing rate, computed quality score."""
    return files_scan(files).select(
        _now(as_of).alias("generated_at"),
        "total_files",
        _rate("processed_files", "total_files").alias("processing_rate"),
        quality_score_overall(metrics).select("quality_score").scalar().alias("quality_score"),
    )


def analytics_insights(analytics_results: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    return {
        "averages": insight_averages(analytics_results),
        "recent_activity": recent_activity(analytics_results, as_of),
    }


def pipeline_status(files: DataFrame, analytics_results: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    return {"completion": pipeline_completion(files), "recent_runs": recent_runs(analytics_results, as_of)}


def dashboard(files: DataFrame, processed_data: DataFrame, analytics_results: DataFrame,
              metrics: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    """All dashboard frames, lazy; each reads only the columns it needs."""
    return {
        "file_type_distribution": file_type_distribution(files),
        "processing_stats": processing_stats(files, processed_data, analytics_results),
        "quality_overview": quality_overview(metrics),
        **analytics_insights(analytics_results, as_of),
    }
