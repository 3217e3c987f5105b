"""The bucketed store: joins without shuffles, flags by day, pages by rank, the stream's state."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from doclake.operators import etl
from doclake.plans.paging import RankDirectory
from doclake.sources.tables import TableStore
from doclake.streaming import incremental


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def subtree(plan, root):
    """The lines below the first operator of a printed plan that matches ``root``."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if root in line)
    depth = lambda line: len(re.match(r"[\s:]*(?:[+:]-)?\s*", line).group())
    end = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    return "\n".join(lines[at + 1 : end])


def fill(store, n, first=0, day=1, processed=True):
    ids = store.spark.range(first, first + n)
    at = F.lit(dt.datetime(2024, 1, day, 12))
    store.append("files", ids.select(F.concat(F.lit("f"), "id").alias("file_id"), F.lit("x.txt").alias("filename"), F.lit(".txt").alias("file_type"),
                                     F.lit(processed).alias("processed"), at.alias("upload_date")))
    store.append("processed_data", ids.select(
        F.concat(F.lit("d"), "id").alias("data_id"), F.concat(F.lit("f"), "id").alias("file_id"), F.lit("text").alias("content_type"),
        F.concat(F.lit("good words here "), F.col("id").cast("string")).alias("extracted_text")))
    return store


@pytest.fixture
def store(spark, folder):
    return TableStore(spark, folder + "/it's a store", buckets=4).create_tables()


def test_a_store_keeps_its_layout(spark, store):
    fill(store, 10)
    again = TableStore(spark, store.root, buckets=99)
    assert again.buckets == 4 and again.read("files").count() == 10
    os.makedirs(store.root + "/old/files")
    with pytest.raises(ValueError, match="earlier layout"):
        TableStore(spark, store.root + "/old")
    with pytest.raises(KeyError):
        store.read("nothing")


def test_rows_of_other_sessions_are_seen(spark, store):
    fill(store, 3)
    other = TableStore(spark.newSession(), store.root)
    assert other.read("files").count() == 3
    fill(other, 4, first=10, day=9)
    assert store.read("files").count() == 7 and store.read("processed_data").count() == 7


def test_anti_join_shuffles_nothing(spark, store):
    fill(store, 50)
    etl.etl_run(store, as_of=F.lit(dt.datetime(2024, 1, 3)))
    fill(store, 5, first=100)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        due = etl.due_documents(store.read("files"), store.read("processed_data"), store.read("analytics_results"))
        plan = plan_of(due)
        below = subtree(plan, "LeftAnti")
        assert below.count("Bucketed: true") == 2 and "Exchange" not in below
        # of the join with the files only the documents that are due are shuffled
        assert plan.count("Exchange") == 1 and "Exchange" in subtree(plan, "Inner") and plan.count("Bucketed: true") == 3
        assert {r["data_id"] for r in due.collect()} == {f"d{i}" for i in range(100, 105)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_without_keys_stay(spark, store):
    store.append("files", spark.createDataFrame([(None, "a"), (None, "b"), ("f", "c")], "file_id string, filename string"))
    assert {(r["file_id"], r["filename"], r["day"]) for r in store.read("files").collect()} == {(None, "a", None), (None, "b", None), ("f", "c", None)}
    store.append("files", spark.createDataFrame([], "file_id string"))
    assert store.read("files").count() == 3


def files_of(store, name="files"):
    found = {}
    for folder, _, names in os.walk(store.path(name)):
        for n in names:
            if n.endswith(".parquet"):
                found.setdefault(os.path.basename(folder), set()).add(n)
    return found


def test_flags_rewrite_only_days_that_change(spark, store):
    fill(store, 6, day=1)
    fill(store, 4, first=10, day=2, processed=False)
    store.append("files", spark.createDataFrame([("alone", False, dt.datetime(2024, 1, 3))], "file_id string, processed boolean, upload_date timestamp"))
    store.append("files", spark.createDataFrame([("f10", None)], "file_id string, processed boolean"))  # no day, no flag
    content, before = store.read("files").drop("processed").collect(), files_of(store)
    assert store.set_processed() == 5
    after = files_of(store)
    changed = {d for d in before if before[d] != after[d]}
    assert changed == {"day=2024-01-02", "day=__HIVE_DEFAULT_PARTITION__"} and before.keys() == after.keys()
    assert store.read("files").where("NOT processed").select("file_id").collect() == [("alone",)]
    assert sorted(map(str, store.read("files").drop("processed").collect())) == sorted(map(str, content))
    assert store.set_processed() == 0 and files_of(store) == after
    assert store.reset_processed() == 11 and store.read("files").where("processed").count() == 0
    assert files_of(store)["day=2024-01-03"] == after["day=2024-01-03"]  # nothing was set there


# ----------------------------------------------------------------------------- pages by rank


def listed(df, key, page, size):
    return [tuple(r) for r in df.orderBy(key).offset(page * size).limit(size).collect()]


def test_pages_equal_a_sorted_table(spark, store):
    ids = spark.range(12_000).select(F.md5(F.col("id").cast("string")).alias("file_id"), F.col("id").cast("string").alias("filename"))
    store.append("files", ids)
    table = store.read("files").select("file_id", "filename")
    ranks = store.ranks("files")
    ranks.rows_per_range = 500
    ranks.refresh(table)
    ordered = [tuple(r) for r in table.orderBy("file_id").collect()]
    for page, size in ((0, 10), (10_000, 1), (11_999, 1), (12_000, 1), (77, 10), (5, 2000), (3, 0), (1, 11_990)):
        assert [tuple(r) for r in ranks.page(table, page, size).collect()] == ordered[page * size : (page + 1) * size], (page, size)
    assert ranks.page_count(7).collect() == [(12_000, 1715)]
    assert max(r["rows"] for r in ranks._counts(ranks._kept())) < 2000


def test_a_page_reads_one_range_and_sorts_no_table(spark, store):
    fill(store, 3000)
    ranks = store.ranks("files")
    ranks.rows_per_range = 100
    table = store.read("files").select("file_id", "filename")
    plan = plan_of(ranks.refresh(table).page(table, 150, 10))
    assert "PushedFilters: [In(file_id" in plan and "Exchange rangepartitioning" not in plan
    assert not re.search(r"^\W*Sort ", plan, re.M)
    keys, _ = ranks.page_keys(150, 10)
    assert len(keys) == 10


def test_pages_follow_appends_and_changes(spark, store):
    def check(segments):
        table = store.read("files").select("file_id", "filename", "processed")
        ranks.refresh(table)
        assert len(ranks._kept()["segments"]) == segments
        every = [tuple(r) for r in table.orderBy("file_id").collect()]
        assert ranks.rows() == len(every)
        for page in (0, 3, len(every) // 10, len(every) // 10 + 1):
            assert [tuple(r) for r in ranks.page(table, page, 10).collect()] == every[page * 10 : page * 10 + 10]

    ranks = store.ranks("files")
    ranks.rows_per_range = 50
    check(1)  # an empty table
    fill(store, 300)
    check(1)
    version = ranks._kept()["version"]
    check(1)
    assert ranks._kept()["version"] == version  # nothing new, nothing written
    fill(store, 200, first=1000, day=2, processed=False)  # keys between, below and above the known ones
    store.append("files", spark.createDataFrame([("",), ("zzz",)], "file_id string"))
    check(2)
    store.set_processed()  # rewritten files: the directory starts anew
    check(1)


def test_pages_of_repeated_and_missing_keys(spark, folder):
    rows = [(None,)] * 25 + [(7,)] * 40 + [(i,) for i in range(60)] + [(-3,)]
    path = folder + "/numbers"
    spark.createDataFrame(rows, "k long").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    ranks = RankDirectory(spark, folder + "/ranks", "k", rows_per_range=10).refresh(table)
    spark.createDataFrame([(None,), (7,), (1000,), (-1000,)], "k long").write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    ranks.refresh(table)
    assert len(ranks._kept()["segments"]) == 2
    for size in (1, 7, 30):
        for page in range(0, 135 // size + 2, {1: 17, 7: 3}.get(size, 1)):
            assert [tuple(r) for r in ranks.page(table, page, size).collect()] == listed(table, "k", page, size), (page, size)


# ------------------------------------------------------------------------------- the stream


def run(store, name, **more):
    query = incremental.incremental_etl(store, f"{store.root}/{name}", **more)
    query.awaitTermination()
    return query


def analysed(store):
    return sorted(r["data_id"] for r in store.read("analytics_results").collect())


def test_a_batch_reads_what_arrived_and_nothing_of_the_store(spark, store, monkeypatch):
    at = dt.datetime(2024, 2, 3, 4)
    fill(store, 30)
    first = run(store, "c", as_of=F.lit(at))
    assert sum(p["numInputRows"] for p in first.recentProgress) == 60 and len(analysed(store)) == 30
    assert {r["created_date"] for r in store.read("analytics_results").collect()} == {at}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != incremental.STATE["spark.sql.streaming.stateStore.providerClass"]
    fill(store, 2, first=50)
    whole, tables = TableStore.read, []
    monkeypatch.setattr(TableStore, "read", lambda self, name: tables.append(name) or whole(self, name))
    second = incremental.incremental_etl(store, f"{store.root}/c")
    tables.clear()  # what defines the initial state is named when the query starts, and read by its first batch only
    second.awaitTermination()
    assert tables == [] and sum(p["numInputRows"] for p in second.recentProgress) == 4
    monkeypatch.undo()
    assert len(analysed(store)) == 32 and store.read("data_quality_metrics").count() == 32 * 5


def test_texts_wait_in_the_state_until_their_file_is_processed(spark, store, monkeypatch):
    def text(data_id, file_id, words="some words"):
        store.append("processed_data", spark.createDataFrame([(data_id, file_id, words)], "data_id string, file_id string, extracted_text string"))

    def file(file_id, processed):
        store.append("files", spark.createDataFrame([(file_id, processed)], "file_id string, processed boolean"))

    text("d1", "f1"), text("d2", "f1"), text("d3", "f2"), text("none", None), text("null", "f1", None)
    monkeypatch.setattr(incremental, "LISTED", 1)  # the second text of a file has an entry of its own
    run(store, "c")
    assert analysed(store) == []
    file("f1", False)
    run(store, "c")
    assert analysed(store) == []
    file("f1", True), text("d1", "f1", "other words")  # the repeat is not analysed again
    run(store, "c")
    assert analysed(store) == ["d1", "d2"]
    text("d4", "f1")
    run(store, "c")
    assert analysed(store) == ["d1", "d2", "d4"]
    file("f2", True)
    run(store, "c")
    assert analysed(store) == ["d1", "d2", "d3", "d4"]
    assert store.read("data_quality_metrics").count() == 4 * 5


def test_a_flag_that_is_set_later_reaches_the_stream(store):
    fill(store, 4, processed=False)
    run(store, "c")
    assert analysed(store) == []
    assert store.set_processed() == 4
    run(store, "c")
    assert len(analysed(store)) == 4


def test_the_stream_starts_from_what_is_analysed(store):
    fill(store, 6)
    assert etl.etl_run(store, batch_size=4) == 4
    run(store, "c")
    assert analysed(store) == sorted(f"d{i}" for i in range(6))


@pytest.mark.parametrize("fails", ["quality_rows", "analytics_rows"])
def test_a_batch_that_failed_is_repeated_once(store, monkeypatch, fails):
    """It dies before or after the first sink was written; the next run neither loses nor repeats a row."""
    fill(store, 8)
    with monkeypatch.context() as m:
        m.setattr(incremental.etl, fails, lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision|division by zero"):
            run(store, "c")
    fill(store, 1, first=20)
    run(store, "c")
    metrics = store.read("data_quality_metrics")
    assert len(analysed(store)) == len(set(analysed(store))) == 9
    assert metrics.count() == metrics.select("metric_id").distinct().count() == 45


def test_a_batch_that_was_stored_but_not_committed_adds_nothing(store):
    fill(store, 8)
    run(store, "c")
    commits = f"{store.root}/c/commits"  # as if the query had died before it noted the end of its batch
    newest = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for name in (newest, f".{newest}.crc"):
        os.remove(f"{commits}/{name}")
    run(store, "c")
    assert len(analysed(store)) == 8 and store.read("data_quality_metrics").count() == 40
