"""Scans, filters, joins, aggregates, limits and reports."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from doclake.functions import text as TX
from doclake.operators import etl, insights, quality as Q
from doclake.plans import explorer as E, reporting as R
from doclake.plans.paging import RankDirectory
from doclake.plans.rollups import Rollups
from doclake.session import shared_folder
from doclake.sources import ingest, tables as S
from suite.catalog import NOW, QUERIES, as_of, filled_store, query, rounded

# ------------------------------------------------------------------- scans and filters


@query("files_scan", """SELECT count(*) AS total_files, count(*) FILTER (WHERE processed) AS processed_files FROM files""")
def _(t):
    return R.files_scan(t.files)


@query("count_rows", "SELECT count(*) AS row_count FROM processed_data")
def _(t):
    return R.count_rows(t.processed_data)


@query("project_columns", "SELECT file_id, filename, file_type FROM files")
def _(t):
    return t.files.select("file_id", "filename", "file_type")


@query("filter_processed", "SELECT file_id, filename FROM files WHERE processed")
def _(t):
    return R.processed_files(t.files).select("file_id", "filename")


@query("unprocessed_files", "SELECT file_id, filename FROM files WHERE NOT processed")
def _(t):
    return R.unprocessed_files(t.files)


@query("filter_min_bytes", "SELECT data_id FROM processed_data WHERE strlen(extracted_text) > 100")
def _(t):
    return TX.filter_min_bytes(t.processed_data).select("data_id")


@query("filter_status_not_good", "SELECT metric_id, status FROM data_quality_metrics WHERE status <> 'good'")
def _(t):
    return R.not_good(t.data_quality_metrics).select("metric_id", "status")


@query("recent_window", f"""
SELECT file_id, upload_date FROM files WHERE upload_date >= {NOW} - INTERVAL '7' DAY""")
def _(t):
    return R.recent(t.files, "upload_date", days=7, as_of=as_of()).select("file_id", "upload_date")


@query("free_sql", """
SELECT f.file_type, count(*) AS n, count(DISTINCT p.content_type) AS kinds
FROM files f JOIN processed_data p ON f.file_id = p.file_id GROUP BY f.file_type""")
def _(t):
    return E.free_sql(
        t.spark,
        """SELECT f.file_type, count(*) AS n, count(DISTINCT p.content_type) AS kinds
           FROM files f JOIN processed_data p ON f.file_id = p.file_id GROUP BY f.file_type""",
        {"files": t.files, "processed_data": t.processed_data},
    )


@query("mark_processed", """
SELECT file_id, EXISTS (SELECT 1 FROM processed_data p WHERE p.file_id = files.file_id) AS processed FROM files""")
def _(t):
    return S.mark_processed(S.reset_processed(t.files), t.processed_data).select("file_id", "processed")


@query("reset_processed", "SELECT file_id, FALSE AS processed FROM files")
def _(t):
    return S.reset_processed(t.files).select("file_id", "processed")


@query("stored_flags", """
SELECT file_id, EXISTS (SELECT 1 FROM processed_data p WHERE p.file_id = files.file_id) AS processed, CAST(upload_date AS DATE) AS day FROM files""")
def _(t):
    store = filled_store(t, "files", "processed_data")
    store.reset_processed()
    store.set_processed()
    return store.read("files").select("file_id", "processed", "day")


# ------------------------------------------------------------------------------- joins


@query("join_files_processed", """
SELECT f.file_id, f.filename, p.data_id, p.content_type FROM files f JOIN processed_data p ON f.file_id = p.file_id""")
def _(t):
    return etl.join_files_processed(t.files, t.processed_data).select("file_id", "filename", "data_id", "content_type")


@query("extract_unanalyzed", """
SELECT f.file_id, f.filename, p.data_id, p.extracted_text FROM files f JOIN processed_data p ON f.file_id = p.file_id
WHERE f.processed AND NOT EXISTS (SELECT 1 FROM analytics_results a WHERE a.data_id = p.data_id)""")
def _(t):
    return etl.extract_unanalyzed(t.files, t.processed_data, t.analytics_results).select(
        "file_id", "filename", "data_id", "extracted_text"
    )


@query("batch_limit", """
SELECT p.data_id FROM files f JOIN processed_data p ON f.file_id = p.file_id
WHERE f.processed AND NOT EXISTS (SELECT 1 FROM analytics_results a WHERE a.data_id = p.data_id)
ORDER BY p.data_id LIMIT 100""")
def _(t):
    return etl.extract_unanalyzed(t.files, t.processed_data, t.analytics_results, batch_size=100).select("data_id")


@query("analyzed_files", """
SELECT count(DISTINCT f.file_id) AS analyzed_files FROM files f JOIN processed_data p ON f.file_id = p.file_id
JOIN analytics_results a ON p.data_id = a.data_id""")
def _(t):
    return R.analyzed_files(t.files, t.processed_data, t.analytics_results)


@query("quality_issues", """
SELECT m.check_type, m.status, m.check_value, m.check_date, f.filename
FROM data_quality_metrics m JOIN files f ON m.file_id = f.file_id WHERE m.status <> 'good'
ORDER BY m.check_date DESC, m.metric_id LIMIT 20""")
def _(t):
    return R.quality_issues(t.data_quality_metrics, t.files)


# -------------------------------------------------------------------------- aggregates


@query("file_type_distribution", "SELECT file_type, count(*) AS count FROM files GROUP BY file_type")
def _(t):
    return R.file_type_distribution(t.files)


@query("file_type_stats", """
SELECT file_type, count(*) AS count, round(avg(file_size), 6) AS avg_size FROM files GROUP BY file_type""")
def _(t):
    return rounded(R.file_type_stats(t.files), "avg_size")


@query("processing_stats", """
SELECT count(*) AS total_files, count(*) FILTER (WHERE processed) AS processed_files,
 (SELECT count(DISTINCT f.file_id) FROM files f JOIN processed_data p ON f.file_id = p.file_id
  JOIN analytics_results a ON p.data_id = a.data_id) AS analyzed_files,
 count(*) FILTER (WHERE processed) / count(*) * 100 AS processing_rate FROM files""")
def _(t):
    return R.processing_stats(t.files, t.processed_data, t.analytics_results)


@query("pipeline_completion", """
SELECT count(*) AS total_files, CAST(sum(CAST(processed AS INT)) AS BIGINT) AS processed_files,
 round(avg(CASE WHEN processed THEN 1 ELSE 0 END) * 100, 6) AS completion_rate FROM files""")
def _(t):
    return rounded(R.pipeline_completion(t.files), "completion_rate")



@query("quality_overview", """
SELECT check_type, status, count(*) AS count FROM data_quality_metrics GROUP BY check_type, status""")
def _(t):
    return R.quality_overview(t.data_quality_metrics)


@query("quality_overview_long", """
SELECT check_type, coalesce(status, 'unknown') AS status, count(*) AS count FROM data_quality_metrics GROUP BY ALL""")
def _(t):
    return R.quality_overview_long(R.quality_overview_nested(t.data_quality_metrics))


AVERAGES = """round(avg(CAST(json_extract_string(results, '$.word_count') AS DOUBLE)), 6) AS avg_word_count,
 round(avg(CAST(json_extract_string(results, '$.sentiment_score') AS DOUBLE)), 6) AS avg_sentiment,
 round(avg(confidence_score), 6) AS avg_confidence"""


@query("insight_averages", f"SELECT {AVERAGES} FROM analytics_results")
def _(t):
    return rounded(R.insight_averages(t.analytics_results), "avg_word_count", "avg_sentiment", "avg_confidence")


@query("analytics_metrics", f"""
SELECT {AVERAGES}, count(*) AS total_analyses,
 count(DISTINCT CAST(created_date AS DATE)) FILTER (WHERE created_date >= {NOW} - INTERVAL '7' DAY) AS active_days
FROM analytics_results""")
def _(t):
    return rounded(
        R.analytics_metrics(t.analytics_results, as_of()), "avg_word_count", "avg_sentiment", "avg_confidence"
    )


@query("recent_activity", f"""
SELECT CAST(created_date AS DATE) AS date, count(*) AS count FROM analytics_results
WHERE created_date >= {NOW} - INTERVAL '7' DAY GROUP BY 1""")
def _(t):
    return R.recent_activity(t.analytics_results, as_of())


@query("recent_runs", f"""
SELECT CAST(created_date AS DATE) AS run_date, count(*) AS records_processed FROM analytics_results
WHERE created_date >= {NOW} - INTERVAL '7' DAY GROUP BY 1""")
def _(t):
    return R.recent_runs(t.analytics_results, as_of())


@query("upload_timeline", f"""
SELECT CAST(upload_date AS DATE) AS date, count(*) AS uploads FROM files
WHERE upload_date >= {NOW} - INTERVAL '30' DAY GROUP BY 1""")
def _(t):
    return R.upload_timeline(t.files, as_of())


@query("new_analytics", f"""
SELECT count(*) AS new_analytics FROM analytics_results WHERE created_date > {NOW} - INTERVAL '1' HOUR""")
def _(t):
    return R.new_rows(t.analytics_results, "created_date", "new_analytics", as_of=as_of())


@query("new_quality_checks", f"""
SELECT count(*) AS new_quality_checks FROM data_quality_metrics WHERE check_date > {NOW} - INTERVAL '1' HOUR""")
def _(t):
    return R.new_rows(t.data_quality_metrics, "check_date", "new_quality_checks", as_of=as_of())


SCORE = """count(*) AS total_checks, count(*) FILTER (WHERE status = 'good') AS passed_checks,
 count(*) FILTER (WHERE status = 'good') / count(*) * 100 AS quality_score"""


@query("quality_score_overall", f"SELECT {SCORE} FROM data_quality_metrics")
def _(t):
    return R.quality_score_overall(t.data_quality_metrics)


@query("quality_score_by_check", f"SELECT check_type, {SCORE} FROM data_quality_metrics GROUP BY check_type")
def _(t):
    return R.quality_score_by_check(t.data_quality_metrics)


@query("quality_band", f"""
SELECT *, CASE WHEN quality_score < 50 THEN 'red' WHEN quality_score < 80 THEN 'yellow' ELSE 'green' END AS band,
 quality_score >= 90 AS meets_target
FROM (SELECT check_type, {SCORE} FROM data_quality_metrics GROUP BY check_type)""")
def _(t):
    return R.quality_band(R.quality_score_by_check(t.data_quality_metrics))


@query("summary_report", """
SELECT count(*) AS total_files, count(*) FILTER (WHERE processed) / count(*) * 100 AS processing_rate,
 (SELECT count(*) FILTER (WHERE status = 'good') / count(*) * 100 FROM data_quality_metrics) AS quality_score
FROM files""")
def _(t):
    return R.summary_report(t.files, t.data_quality_metrics, as_of()).drop("generated_at")


# ------------------------------------------------------------------ paging and samples


@query("sample_rows", "SELECT file_id, filename, file_type FROM files ORDER BY file_id LIMIT 5")
def _(t):
    return E.sample_rows(t.files.select("file_id", "filename", "file_type"), "file_id")


@query("page_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 75")
def _(t):
    return E.page_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", page=3, size=25)


@query("page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def _(t):
    return E.page_after(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 100, size=25)


@query("page_count", "SELECT count(*) AS row_count, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM orders")
def _(t):
    return E.page_count(t.orders, 25)


@query("ml_sample", """
SELECT data_id, CAST(length(extracted_text) AS INT) AS char_count FROM processed_data
WHERE strlen(extracted_text) > 100""")
def _(t):
    return insights.ml_sample(t.processed_data).select("data_id", "char_count")


# ---------------------------------------------------- reports of several frames, as one long frame

# frame: key column, measures; the checking SQL is that of the query of the same name
FRAMES = {
    "file_type_distribution": ("file_type", ["count"]),
    "processing_stats": (None, ["total_files", "processed_files", "analyzed_files", "processing_rate"]),
    "quality_overview": ("concat_ws('/', check_type, status)", ["count"]),
    "insight_averages": (None, ["avg_word_count", "avg_sentiment", "avg_confidence"]),
    "recent_activity": ("date", ["count"]),
    "pipeline_completion": (None, ["total_files", "processed_files", "completion_rate"]),
    "recent_runs": ("run_date", ["records_processed"]),
    "page_rows": ("o_orderkey", ["o_totalprice"]),
    "page_count": (None, ["row_count", "total_pages"]),
    "count_orders": (None, ["row_count"]),
    "first_orders": ("o_orderkey", ["o_totalprice"]),
}


def long_sql(*names: str) -> str:
    own = {"count_orders": "SELECT count(*) AS row_count FROM orders",
           "first_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5"}
    return " UNION ALL ".join(
        f"SELECT '{n}' AS frame, CAST({FRAMES[n][0] or 'NULL'} AS VARCHAR) AS key, '{m}' AS measure, round(CAST({m} AS DOUBLE), 6) AS value "
        f"FROM ({own.get(n) or QUERIES[n].sql})" for n in names for m in FRAMES[n][1])


def long_frame(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows (frame, key, measure, value) of the frames of a report."""
    def one(name: str, df: DataFrame) -> DataFrame:
        key, measures = FRAMES[name]
        values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 6).alias("value")) for m in measures])
        return df.select(F.lit(name).alias("frame"), F.expr(f"CAST({key or 'NULL'} AS STRING)").alias("key"), F.inline_outer(values))

    return reduce(DataFrame.unionAll, [one(n, df) for n, df in frames.items()])


@query("dashboard", long_sql("file_type_distribution", "processing_stats", "quality_overview", "insight_averages", "recent_activity"))
def _(t):
    frames = R.dashboard(t.files, t.processed_data, t.analytics_results, t.data_quality_metrics, as_of())
    return long_frame({"insight_averages" if n == "averages" else n: df for n, df in frames.items()})


@query("analytics_insights", long_sql("insight_averages", "recent_activity"))
def _(t):
    frames = R.analytics_insights(t.analytics_results, as_of())
    return long_frame({"insight_averages": frames["averages"], "recent_activity": frames["recent_activity"]})


@query("pipeline_status", long_sql("pipeline_completion", "recent_runs"))
def _(t):
    frames = R.pipeline_status(t.files, t.analytics_results, as_of())
    return long_frame({"pipeline_completion": frames["completion"], "recent_runs": frames["recent_runs"]})


@query("table_profile", long_sql("count_orders", "first_orders"))
def _(t):
    frames = E.table_profile(t.orders, "o_orderkey")
    return long_frame({"count_orders": frames["row_count"], "first_orders": frames["sample"]})


@query("page_table", long_sql("page_rows", "page_count"))
def _(t):
    frames = E.page_table(t.orders, "o_orderkey", 3, 25)
    return long_frame({"page_rows": frames["rows"], "page_count": frames["pages"]})


# The first pages, one in the middle, the last one and the one behind it.
PAGES = """pages AS (SELECT unnest([0, 1, n // 50, (n - 1) // 25, (n - 1) // 25 + 1]) AS page FROM (SELECT count(*) AS n FROM documents)),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)"""


def _ranks(t):
    folder = f"{shared_folder(t.spark)}/doclake/ranks-{uuid.uuid4().hex}"
    return RankDirectory(t.spark, folder, "doc_id").refresh(t.documents)


@query("page_by_rank", f"""WITH {PAGES} SELECT DISTINCT page, doc_id, lang, n_chars FROM numbered JOIN pages ON place // 25 = page""")
def _(t):
    ranks = _ranks(t)
    n = ranks.rows()
    rows = t.documents.select("doc_id", "lang", "n_chars")
    pages = sorted({0, 1, n // 50, (n - 1) // 25, (n - 1) // 25 + 1})
    return reduce(DataFrame.unionAll, [
        E.page_rows(rows, "doc_id", p, 25, ranks).select(F.lit(p).cast("bigint").alias("page"), "*") for p in pages])


@query("page_count_by_rank", "SELECT count(*) AS row_count, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM documents")
def _(t):
    return E.page_table(t.documents, "doc_id", 0, 25, _ranks(t))["pages"]


@query("export_page_csv", f"""WITH {PAGES} SELECT doc_id, lang, source, n_chars FROM numbered
WHERE place // 25 = (SELECT max(page) - 1 FROM pages)""")
def _(t):
    ranks, path = _ranks(t), f"{shared_folder(t.spark)}/doclake/page-{uuid.uuid4().hex}"
    rows = t.documents.select("doc_id", "lang", "source", "n_chars")
    E.export_page_csv(rows, "doc_id", path, (ranks.rows() - 1) // 25, 25, ranks)
    return t.spark.read.option("header", True).schema(rows.schema).csv(path)


# Stored rows of the day after all others come late; the rollups were made before.
ROLLED = """UNION ALL SELECT 'late', 'd0', 'accuracy', 1.0, NULL, 'good', TIMESTAMP '2024-01-05 10:00:00'"""


@query("rollup_reports", f"""WITH metrics AS (SELECT * FROM data_quality_metrics {ROLLED}),
types AS (SELECT file_type, count(*) AS n, avg(file_size) AS a FROM files GROUP BY file_type)
SELECT 'types' AS report, file_type AS key, n AS count, round(a, 6) AS value FROM types
UNION ALL SELECT 'overview', concat_ws('/', check_type, status), count(*), NULL FROM metrics GROUP BY check_type, status
UNION ALL SELECT 'score', check_type, count(*), round(100.0 * count(*) FILTER (WHERE status = 'good') / count(*), 6) FROM metrics GROUP BY check_type
UNION ALL SELECT 'uploads', CAST(CAST(upload_date AS DATE) AS VARCHAR), count(*), NULL FROM files
 WHERE upload_date >= {NOW} - INTERVAL 30 DAY GROUP BY CAST(upload_date AS DATE)
UNION ALL SELECT 'runs', CAST(CAST(created_date AS DATE) AS VARCHAR), count(*), NULL FROM analytics_results
 WHERE created_date >= {NOW} - INTERVAL 7 DAY GROUP BY CAST(created_date AS DATE)
UNION ALL SELECT 'averages', 'words', count(*), round(avg(CAST(json_extract_string(results, '$.word_count') AS DOUBLE)), 6) FROM analytics_results""")
def _(t):
    store = filled_store(t, "files", "analytics_results", "data_quality_metrics")
    rollups = Rollups(store)
    rollups.refresh()
    late = t.spark.createDataFrame([("late", "d0", "accuracy", 1.0, "good", "2024-01-05 10:00:00")],
                                   "metric_id string, file_id string, check_type string, check_value double, status string, at string")
    store.append("data_quality_metrics", late.withColumn("check_date", F.col("at").cast("timestamp")))
    rollups.refresh()

    def shown(report: str, df: DataFrame, key: str, count: str, value: str | None = None) -> DataFrame:
        number = F.round(F.col(value), 6) if value else F.lit(None).cast("double")
        return df.select(F.lit(report).alias("report"), F.expr(f"CAST({key} AS STRING)").alias("key"), F.col(count).alias("count"), number.alias("value"))

    averages = rollups.analytics_metrics(as_of())
    return reduce(DataFrame.unionAll, [
        shown("types", rollups.file_type_stats(), "file_type", "count", "avg_size"),
        shown("overview", rollups.quality_overview(), "concat_ws('/', check_type, status)", "count"),
        shown("score", rollups.quality_score_by_check(), "check_type", "total_checks", "quality_score"),
        shown("uploads", rollups.upload_timeline(as_of()), "date", "uploads"),
        shown("runs", rollups.recent_runs(as_of()), "run_date", "records_processed"),
        shown("averages", averages, "'words'", "total_analyses", "avg_word_count")])


# -------------------------------------------------------------------------- key checks


@query("key_uniqueness", "SELECT file_id, count(*) AS n FROM processed_data GROUP BY file_id HAVING count(*) > 1")
def _(t):
    return Q.key_duplicates(t.processed_data, "file_id")


KEYS = {"files": "file_id", "processed_data": "data_id", "analytics_results": "analysis_id", "data_quality_metrics": "metric_id"}
REFERENCES = [("processed_data", "files", "file_id"), ("analytics_results", "processed_data", "data_id"),
              ("data_quality_metrics", "files", "file_id")]


@query("key_uniqueness_all", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY {key})"
    for table, key in KEYS.items()))
def _(t):
    return reduce(DataFrame.unionAll, [
        getattr(t, table).groupBy(key).agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("repeated"))
        .select(F.lit(table).alias("table_name"), "n_keys", "repeated") for table, key in KEYS.items()])


@query("orphan_rows_all", " UNION ALL ".join(
    f"SELECT '{child}' AS table_name, {key} AS missing, count(*) AS n FROM {child} c "
    f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key}) AND {key} IS NOT NULL GROUP BY {key}"
    for child, parent, key in REFERENCES))
def _(t):
    return reduce(DataFrame.unionAll, [
        Q.orphan_rows(getattr(t, child), getattr(t, parent), key).groupBy(key).agg(F.count("*").alias("n"))
        .select(F.lit(child).alias("table_name"), F.col(key).alias("missing"), "n") for child, parent, key in REFERENCES])


# Written as CSV part files and read back.
@query("csv_round_trip", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = f"{shared_folder(t.spark)}/doclake/csv-{uuid.uuid4().hex}"
    E.export_csv(rows, path)
    return ingest.read_csv_table(t.spark, path, rows.schema)


@query("orphan_rows", """
SELECT metric_id, file_id FROM data_quality_metrics m
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.file_id = m.file_id)""")
def _(t):
    return Q.orphan_rows(t.data_quality_metrics, t.files, "file_id").select("metric_id", "file_id")
