import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from doclake import schema
from doclake.operators import etl, quality as Q
from doclake.plans import reporting as R
from doclake.session import discard, written
from doclake.sources.tables import TableStore, create_catalog_tables, mark_processed, reset_processed
from doclake.streaming.incremental import incremental_etl

DOC = "data_id string, file_id string, file_type string, content_type string, extracted_text string"


def checks_of(spark, text, file_type="a", content_type="a", **options):
    df = spark.createDataFrame([("d", "f", file_type, content_type, text)], DOC)
    return {r["check_type"]: (r["check_value"], r["status"]) for r in Q.quality_checks(df, **options).collect()}


@pytest.mark.parametrize("text, want", [
    ("", (0.0, "failed")), ("  ", (0.0, "failed")), ("w " * 9, (0.3, "poor")), ("w " * 10, (0.6, "fair")),
    ("w " * 49, (0.6, "fair")), ("w " * 50, (0.9, "good"))])
def test_completeness(spark, text, want):
    assert checks_of(spark, text)["completeness"] == want


def test_validity(spark):
    assert checks_of(spark, "a b c d e f g h i NULL")["validity"] == (0.9, "good")
    assert checks_of(spark, "a b c d NULL")["validity"] == (0.8, "poor")
    assert checks_of(spark, "NULLNULL undefined �")["validity"] == (0.0, "poor")
    assert checks_of(spark, "x" * 1_000_000)["validity"] == (1.0, "good")
    assert checks_of(spark, "x" * 1_000_001)["validity"] == (0.2, "poor")


def test_other_checks(spark):
    got = checks_of(spark, "a b c d e f g a a a", ".txt", "text")
    assert got["uniqueness"] == (0.7, "fair") and got["consistency"] == (0.5, "fair") and got["accuracy"] == (0.8, "good")
    assert checks_of(spark, "a", ".txt", "text", mode="category")["consistency"] == (0.9, "good")
    assert checks_of(spark, "a", None, None)["consistency"] == (0.9, "good")
    assert list(got) == Q.CHECKS


def test_null_text(spark):
    assert checks_of(spark, None) == {"completeness": (0.0, "failed"), "error": (0.0, "failed")}


def test_rules_and_keys(spark):
    docs = spark.createDataFrame(
        [("1", "f1", "a", "a", "short", 10), ("2", "f2", "a", "b", "w " * 60, 300 * 2**20), ("3", "f3", "a", "a", None, 1)],
        DOC + ", file_size long")
    got = {(r["data_id"], r["rule"]) for r in Q.quality_rules(docs).collect()}
    assert got == {("1", "min_word_count"), ("1", "completeness"), ("2", "max_file_size"), ("2", "consistency"),
                   ("3", "min_word_count"), ("3", "require_text_content"), ("3", "completeness")}
    lenient = Q.quality_rules(docs, min_words=1, max_size_mb=1000, require_text=False, check_completeness=False,
                              check_validity=False, check_consistency=False)
    assert [tuple(r) for r in lenient.collect()] == [("3", "f3", "min_word_count")]
    twice = docs.unionAll(docs.where("data_id = '1'"))
    assert [tuple(r) for r in Q.key_duplicates(twice, "data_id").collect()] == [("1", 2)]
    parents = docs.where("data_id <> '2'").select("file_id")
    assert [r["file_id"] for r in Q.orphan_rows(docs, parents, "file_id").collect()] == ["f2"]


@pytest.fixture
def store(spark, folder):
    s = TableStore(spark, folder + "/store").create_tables()
    n = 40
    files = spark.range(n).select(
        F.concat(F.lit("f"), "id").alias("file_id"), F.lit("x.txt").alias("filename"), F.lit(".txt").alias("file_type"),
        (F.col("id") != 3).alias("processed"), F.lit(b"raw").alias("content"))
    texts = spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("data_id"), F.concat(F.lit("f"), "id").alias("file_id"), F.lit("text").alias("content_type"),
        F.when(F.col("id") != 5, F.concat(F.lit("good words here "), F.col("id").cast("string"))).alias("extracted_text"))
    s.append("files", files)
    s.append("processed_data", texts)
    return s


def test_tables(store, spark):
    store.create_tables()  # a second time changes nothing
    assert store.read("files").count() == 40
    assert store.read("processed_data").schema == schema.PROCESSED_DATA
    spark.sql("CREATE DATABASE IF NOT EXISTS doclake_test")
    create_catalog_tables(spark, "doclake_test")
    create_catalog_tables(spark, "doclake_test")
    assert spark.table("doclake_test.files").schema.names == schema.FILES.names
    spark.sql("DROP DATABASE doclake_test CASCADE")


def test_etl_twice_adds_nothing(store):
    assert etl.etl_run(store) == 38  # 40 without the unprocessed file and the NULL text
    assert store.read("data_quality_metrics").count() == 38 * 5
    assert etl.etl_run(store) == 0
    rows = store.read("analytics_results")
    assert rows.count() == 38 and rows.select("data_id").distinct().count() == 38
    one = rows.where("data_id = 'd1'").first()
    assert one["insights"] == "Processed file with 4 words" and one["confidence_score"] == 0.25
    assert store.read("data_quality_metrics").count() == 38 * 5


def test_etl_after_a_crash_between_the_sinks(store):
    docs = etl.extract_unanalyzed(store.read("files"), store.read("processed_data"), store.read("analytics_results"))
    store.append("data_quality_metrics", etl.quality_rows(etl.etl_transform(docs)))
    etl.etl_run(store)
    metrics = store.read("data_quality_metrics")
    assert metrics.count() == 38 * 5 and metrics.select("metric_id").distinct().count() == 38 * 5


def test_etl_batches(store):
    done = []
    while n := etl.etl_run(store, batch_size=15):
        done.append(n)
    assert sum(done) == 38 and max(done) <= 15


def test_null_texts_do_not_block_batches(store):
    rows = [(f"a{i}", f"f{i}", "text", None) for i in range(10)]
    store.append("processed_data", store.spark.createDataFrame(
        rows, "data_id string, file_id string, content_type string, extracted_text string"))
    assert etl.etl_run(store, batch_size=5) == 5


def test_extract_plan(store):
    df = etl.extract_unanalyzed(store.read("files"), store.read("processed_data"), store.read("analytics_results"))
    plan = etl.etl_transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "EvalPython" not in plan and "content:binary" not in plan
    assert "PushedFilters: [IsNotNull(processed), EqualTo(processed,true)" in plan


def test_a_small_batch_leaves_the_texts_unshuffled(store):
    due = written(etl.due_documents(store.read("files"), store.read("processed_data"), store.read("analytics_results")), "due")
    plan = etl.with_texts(due, store.read("processed_data"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    discard(due)


def test_incremental(store, folder):
    def run():
        incremental_etl(store, folder + "/checkpoint").awaitTermination()
        return store.read("analytics_results").count()

    assert run() == 38 and run() == 38
    more = store.spark.createDataFrame([("new", "f7", "text", "late words")], "data_id string, file_id string, content_type string, extracted_text string")
    store.append("processed_data", more)
    assert run() == 39
    assert store.read("data_quality_metrics").count() == 39 * 5


def test_processed_flags(store):
    files = reset_processed(store.read("files"))
    assert files.where("processed").count() == 0
    some = store.read("processed_data").where("data_id < 'd2'")
    assert mark_processed(files, some.unionAll(some)).where("processed").count() == some.count()
    assert mark_processed(files, some).count() == 40


def test_reports(spark, store):
    etl.etl_run(store, as_of=F.lit(dt.datetime(2024, 1, 2, 3)))
    now = F.lit(dt.datetime(2024, 1, 2, 3, 30))
    frames = R.dashboard(*[store.read(n) for n in schema.TABLES], as_of=now)
    assert frames["processing_stats"].first().asDict() == {
        "total_files": 40, "processed_files": 39, "analyzed_files": 38, "processing_rate": 97.5}
    assert [tuple(r) for r in frames["recent_activity"].collect()] == [(dt.date(2024, 1, 2), 38)]
    assert frames["averages"].first()["avg_word_count"] == 4.0
    status = R.pipeline_status(store.read("files"), store.read("analytics_results"), now)
    assert status["completion"].first()["completion_rate"] == 97.5
    assert R.new_rows(store.read("analytics_results"), "created_date", "n", as_of=now).first()["n"] == 38
    empty = store.read("files").where("false")
    assert R.processing_stats(empty, store.read("processed_data"), store.read("analytics_results")).first()["processing_rate"] == 0.0
    assert R.pipeline_completion(empty).first()["completion_rate"] is None
    assert R.quality_score_overall(store.read("data_quality_metrics").where("false")).first()["quality_score"] == 0.0
    nested = {r[0]: r[1] for r in R.quality_overview_nested(store.read("data_quality_metrics")).collect()}
    assert nested["accuracy"] == {"good": 38}


def test_results_are_stored_by_day(spark, store):
    now = F.lit(dt.datetime(2024, 1, 20, 3))
    for day in (1, 13, 14, 19, 20):
        rows = spark.createDataFrame([(f"a{day}", "d", dt.datetime(2024, 1, day, 3))], "analysis_id string, data_id string, created_date timestamp")
        store.append("analytics_results", rows)
    store.append("analytics_results", spark.createDataFrame([("none",)], "analysis_id string"))
    table = store.read("analytics_results")
    assert table.columns == [*schema.ANALYTICS_RESULTS.names, "day"] and table.count() == 6
    found = R.recent_activity(table, now)
    assert [r["date"].day for r in found.collect()] == [20, 19, 14, 13]
    assert R.new_rows(table, "created_date", "n", hours=24, as_of=now).first()["n"] == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    # 7 days before the 20th are the 13th; one day more for other time zones
    assert re.search(r"PartitionFilters: \[\(isnull\(day#\d+\) OR \(day#\d+ >= 2024-01-12\)\)\]", plan)
    same = R.recent_activity(table.drop("day"), now)  # without the column every row is read
    assert same.collect() == found.collect()


def test_incremental_waits_for_the_file(store, folder):
    """A text that a run sees before its file's row, or before the file is marked processed, is not lost."""
    spark, read = store.spark, store.read("files")

    def files(file_id, done):
        rows = spark.createDataFrame([(file_id, done)], "file_id string, processed boolean")
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in read.dtypes])

    def texts(data_id, file_id):
        rows = spark.createDataFrame([(data_id, file_id, "A text of some words.")], "data_id string, file_id string, extracted_text string")
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in store.read("processed_data").dtypes])

    def run():
        before = store.read("analytics_results").count()
        incremental_etl(store, folder + "/late").awaitTermination()
        return store.read("analytics_results").count() - before

    run()
    store.append("processed_data", texts("late1", "latefile1"))
    assert run() == 0
    store.append("files", files("latefile1", True))
    assert run() == 1 and run() == 0
