"""The four tables of the data model, derived from the given tables by one SQL text.

Spark and the checking engine run the same statements; only the name of the function that
counts bytes differs. Every row of the given tables is used:

* each document is an uploaded, processed file with its whole text, to which some words
  are appended so that sentiment and validity have something to find;
* each page is a crawled file that is not processed yet;
* each benchmark item is a scan whose extraction gave NULL once and an empty text once;
* each label is an analysis of its document; each event is a quality metric.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 15:30:00"

EXT = """CASE doc_id % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.pdf'
 WHEN 3 THEN '.docx' WHEN 4 THEN '.pptx' WHEN 5 THEN '.png' WHEN 6 THEN '.mp3'
 WHEN 7 THEN '.zip' ELSE '.html' END"""
CATEGORY = """CASE doc_id % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'spreadsheets' WHEN 2 THEN 'documents'
 WHEN 3 THEN 'documents' WHEN 4 THEN 'presentations' WHEN 5 THEN 'images' WHEN 6 THEN 'audio'
 WHEN 7 THEN 'archives' ELSE 'unknown' END"""
WHEN_ADDED = "TIMESTAMP '2023-12-20 00:00:00' + INTERVAL '1' HOUR * CAST({id} % 1000 AS INT)"

VIEWS = {
    "files": f"""
SELECT concat('d', CAST(doc_id AS STRING)) AS file_id,
 concat('doc_', CAST(doc_id AS STRING), {EXT}) AS filename, {EXT} AS file_type,
 CAST({{octets}}(text) AS BIGINT) AS file_size, 'upload' AS source_type,
 {WHEN_ADDED.format(id='doc_id')} AS upload_date, TRUE AS processed
FROM documents
UNION ALL
SELECT concat('w', CAST(page_id AS STRING)), concat('webpage_', CAST(page_id AS STRING), '.html'), '.html',
 CAST({{octets}}(html) AS BIGINT), 'web_crawl', {WHEN_ADDED.format(id='page_id')}, FALSE
FROM pages
UNION ALL
SELECT concat('b', CAST(item_id AS STRING)), concat('scan_', CAST(item_id AS STRING), '.pdf'), '.pdf',
 CAST({{octets}}(text) AS BIGINT), 'upload', {WHEN_ADDED.format(id='item_id')}, TRUE
FROM benchmark""",
    "processed_data": f"""
SELECT concat('p', CAST(doc_id AS STRING)) AS data_id, concat('d', CAST(doc_id AS STRING)) AS file_id,
 CASE WHEN doc_id % 4 = 0 THEN {EXT} ELSE {CATEGORY} END AS content_type,
 concat(text,
  CASE doc_id % 7 WHEN 0 THEN ' good great excellent good' WHEN 1 THEN ' bad terrible poor'
   WHEN 2 THEN ' Good bad awesome.' WHEN 3 THEN ' superb, SUPERB mediocre awful' ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN repeat(' NULL undefined', 40) ELSE '' END) AS extracted_text
FROM documents
UNION ALL
SELECT concat('n', CAST(item_id AS STRING)), concat('b', CAST(item_id AS STRING)), 'documents', CAST(NULL AS STRING)
FROM benchmark
UNION ALL
SELECT concat('e', CAST(item_id AS STRING)), concat('b', CAST(item_id AS STRING)), 'documents', ''
FROM benchmark""",
    "analytics_results": f"""
SELECT concat('a', CAST(doc_id AS STRING)) AS analysis_id, concat('p', CAST(doc_id AS STRING)) AS data_id,
 'basic_analytics' AS analysis_type,
 concat('{{{{"word_count": ', CAST(doc_id % 500 AS STRING), ', "sentiment_score": 0.', CAST(doc_id % 8 * 125 AS STRING), '}}}}') AS results,
 CAST(quality AS DOUBLE) - CAST(toxic AS DOUBLE) / 2 AS confidence_score,
 {WHEN_ADDED.format(id='doc_id')} AS created_date
FROM labels""",
    "data_quality_metrics": """
SELECT concat('m', CAST(event_id AS STRING)) AS metric_id,
 concat(CASE WHEN value > 200 THEN 'gone' ELSE 'd' END, CAST(user_id AS STRING)) AS file_id,
 CASE event_type WHEN 'view' THEN 'completeness' WHEN 'error' THEN 'validity' WHEN 'click' THEN 'consistency'
  WHEN 'signup' THEN 'uniqueness' ELSE 'accuracy' END AS check_type,
 CASE WHEN value < 100 THEN value / 100 ELSE 1.0 END AS check_value, CAST(NULL AS DOUBLE) AS threshold,
 CASE WHEN value < 3 THEN NULL WHEN value < 10 THEN 'failed' WHEN value < 20 THEN 'poor'
  WHEN value < 30 THEN 'fair' ELSE 'good' END AS status,
 ts AS check_date
FROM events""",
    # Pages as one site per host: a heap-shaped link tree plus links that must not be followed.
    "site_pages": """
SELECT page_id,
 concat('http://s', CAST(page_id % {hosts} AS STRING), '.example.com/p/', CAST(page_id AS STRING)) AS url,
 replace(html, '</article>', concat(
  '<a href="/p/', CAST(2 * page_id + {hosts} - page_id % {hosts} AS STRING), '">next</a> ',
  '<a href="/p/', CAST(2 * page_id + 2 * {hosts} - page_id % {hosts} AS STRING), '#part">part</a> ',
  '<a href="/p/', CAST(page_id % {hosts} AS STRING), '">home</a> ',
  '<a href="/files/a.pdf">file</a> <a href="mailto:a@b.org">mail</a> <a href="http://other.example.org/">out</a>',
  '</article>')) AS html
FROM pages""",
}
# Columns of the given tables in use; naming them saves the footer job of every read.
GIVEN = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
}


# Below this size a file is one or two row groups, so one or two tasks would do all the work.
SMALL_BYTES = 64 * 1024 * 1024
WIDE_TABLES = {"documents", "pages"}


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table. ``spread`` deals the rows of a small file of texts to all cores.

    Large tables have enough row groups of their own and are never reshuffled for this.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.schema(GIVEN[name]).parquet(path)
    if spread and name in WIDE_TABLES:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = location.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.getContentSummary(location).getLength() < SMALL_BYTES:
            return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def statement(name: str, engine: str, hosts: int = 1) -> str:
    return VIEWS[name].format(octets="octet_length" if engine == "spark" else "strlen", hosts=hosts)


def view(spark: SparkSession, sf_dir: str, name: str, hosts: int = 1) -> DataFrame:
    """A derived table as a frame."""
    sql = statement(name, "spark", hosts)
    for t in GIVEN:
        if f"FROM {t}" in sql:
            load(spark, sf_dir, t, spread=name in ("processed_data", "site_pages")).createOrReplaceTempView(f"given_{t}")
            sql = sql.replace(f"FROM {t}", f"FROM given_{t}")
    return spark.sql(sql)


def with_views(sql: str, hosts: int = 1) -> str:
    """The checking SQL with the derived tables it names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS ({statement(v, 'duckdb', hosts)})" for v in used)
    head = re.match(r"(?is)\s*with\s+(recursive\s+)?", sql)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"
