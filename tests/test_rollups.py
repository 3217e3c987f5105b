"""Reports from rollups equal those from the tables, before and after late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from doclake import schema
from doclake.plans import reporting as R
from doclake.plans.rollups import Rollups
from doclake.sources.tables import TableStore

NOW = dt.datetime(2024, 1, 20, 12, 30)


def fill(store, ids, days):
    """Rows on the given days, at hours around noon; some values, flags and times are missing."""
    rows = store.spark.createDataFrame([(i, d) for i in ids for d in days], "id long, day int")
    at = F.when(F.col("day") > 0, F.make_timestamp(F.lit(2024), F.lit(1), "day", (F.col("id") % 24).cast("int"), F.lit(30), F.lit(0)))
    key = F.concat_ws("-", "id", "day")
    store.append("files", rows.select(
        key.alias("file_id"), F.element_at(F.array(F.lit(".txt"), F.lit(".csv"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("file_type"),
        F.when(F.col("id") % 7 > 0, F.col("id") * 100).alias("file_size"), F.when(F.col("id") % 5 > 0, F.col("id") % 2 == 0).alias("processed"), at.alias("upload_date")))
    store.append("processed_data", rows.select(F.concat(F.lit("d"), key).alias("data_id"), key.alias("file_id")))
    store.append("analytics_results", rows.where("id % 4 > 0").select(
        F.concat(F.lit("a"), key).alias("analysis_id"), F.concat(F.lit("d"), key).alias("data_id"), F.when(F.col("id") % 6 > 0, F.concat(
            F.lit('{"word_count": '), F.col("id"), F.lit(', "sentiment_score": 0.'), F.col("id") % 8 * 125, F.lit("}"))).otherwise("broken {").alias("results"),
        (F.col("id") % 3 / 2).alias("confidence_score"), at.alias("created_date")))
    store.append("data_quality_metrics", rows.select(
        F.concat(F.lit("m"), key).alias("metric_id"), key.alias("file_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("check_type"),
        F.element_at(F.array(F.lit("good"), F.lit("poor"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("status"), at.alias("check_date")))


@pytest.fixture
def store(spark, folder):
    return TableStore(spark, folder + "/store", buckets=2).create_tables()


def rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


def same(store, rollups):
    files, texts, results, metrics = (store.read(n) for n in schema.TABLES)
    now = F.lit(NOW)
    pairs = {
        "files_scan": (rollups.files_scan(), R.files_scan(files)),
        "distribution": (rollups.file_type_distribution(), R.file_type_distribution(files)),
        "stats": (rollups.file_type_stats(), R.file_type_stats(files)),
        "completion": (rollups.pipeline_completion(), R.pipeline_completion(files)),
        "timeline": (rollups.upload_timeline(now, 3), R.upload_timeline(files, now, 3)),
        "overview": (rollups.quality_overview(), R.quality_overview(metrics)),
        "overall": (rollups.quality_score_overall(), R.quality_score_overall(metrics)),
        "by check": (rollups.quality_score_by_check(), R.quality_score_by_check(metrics)),
        "averages": (rollups.insight_averages(), R.insight_averages(results)),
        "metrics": (rollups.analytics_metrics(now), R.analytics_metrics(results, now)),
        "activity": (rollups.recent_activity(now), R.recent_activity(results, now)),
        "runs": (rollups.pipeline_status(now)["recent_runs"], R.recent_runs(results, now)),
        "new": (rollups.new_rows("analytics_results", "n", 30, now), R.new_rows(results, "created_date", "n", 30, now)),
        "summary": (rollups.summary_report(now), R.summary_report(files, metrics, now)),
        "processing": (rollups.dashboard(now)["processing_stats"], R.processing_stats(files, texts, results)),
    }
    ordered = {"distribution", "stats", "timeline", "activity", "runs"}
    for name, (got, want) in pairs.items():
        assert got.columns == want.columns, name
        a, b = rounded(got), rounded(want)
        assert (a == b) if name in ordered else sorted(map(str, a)) == sorted(map(str, b)), (name, a, b)


def rollup_files(store, name):
    return {d: sorted(os.listdir(f"{store.root}/_rollups/{name}/{d}")) for d in os.listdir(f"{store.root}/_rollups/{name}") if d.startswith("day=")}


def test_rollups_equal_reports_after_late_rows(store):
    rollups = Rollups(store)
    assert rollups.refresh() == {n: 0 for n in ("files", "analytics_results", "data_quality_metrics")}
    same(store, rollups)  # empty tables
    fill(store, range(30), [2, 13, 14, 19, 20])
    assert set(rollups.refresh().values()) == {5}
    before = rollup_files(store, "files")
    fill(store, range(100, 112), [13, 0])  # late rows, and rows without a time
    assert set(rollups.refresh().values()) == {2}
    after = rollup_files(store, "files")
    assert {d for d in before if before[d] != after[d]} == {"day=2024-01-13"}
    assert set(rollups.refresh().values()) == {0}
    store.reset_processed()
    store.set_processed()
    assert rollups.refresh()["analytics_results"] == 0
    same(store, rollups)


def test_reports_read_rollups_only(store):
    fill(store, range(30), [2, 19])
    rollups = Rollups(store)
    rollups.refresh()
    for frame in (rollups.quality_overview(), rollups.file_type_stats(), rollups.insight_averages()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "_rollups" in plan and "spark_catalog" not in plan
    recent = rollups.recent_activity(F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    assert "(day#" in recent and "= 2024-01-13)" in recent  # of the table, the bound's own day alone


def test_stored_results_are_not_parsed_again(store):
    fill(store, range(30), [2])
    table = store.read("analytics_results")
    plan = R.insight_averages(table)._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" not in plan and "parse_json" not in plan and "variant_get" in plan
    assert "results:string" not in plan  # the text is not read
    assert rounded(R.insight_averages(table)) == rounded(R.insight_averages(table.drop("parsed_results")))
    assert rounded(R.analytics_metrics(table, F.lit(NOW))) == rounded(R.analytics_metrics(table.drop("parsed_results"), F.lit(NOW)))
