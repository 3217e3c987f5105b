"""The registered queries next to their SQL, on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from suite.check import compare, connect

SF = "/root/testdata/sf0.001"
# Queries that the other tests cover by their own fixtures and that take long here.
SLOW = {"crawl_bfs", "crawl_summary", "crawl_results", "crawl_max_depth", "crawl_many", "crawl_source_summary",
        "etl_run", "incremental_etl", "tfidf_weights"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]).startswith("equal")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_large_files_are_as_many_as_the_texts_fill(spark, tmp_path):
    from pathlib import Path

    rows = spark.range(3000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 8), k -> sha2(concat(id, ':', k), 256)), '') AS text", "'en' AS lang", "'s' AS source", "512L AS n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    kept, size = Path(spark.conf.get("spark.checkpoint.dir")) / "doclake", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = set(kept.glob("texts-*"))
    spark.conf.set(size, "65536")
    try:
        found = {r["kind"]: (r["n_chars"], r["n_open"]) for r in entry.queries()["text_file_parts"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(size)
    assert found == {"text": (3000 * 513, 0), "csv": (3000 * 515, 0)}
    (folder,) = set(kept.glob("texts-*")) - before
    assert len([*(folder / "text").glob("part-*")]) > 4 < len([*(folder / "csv").glob("part-*")])


def test_vectors_are_checked_sparse(spark):
    from pathlib import Path

    kept = Path(spark.conf.get("spark.checkpoint.dir")) / "doclake"
    before = set(kept.glob("assigned-*"))
    assert entry.queries()["clustering_checked"](spark, SF).first()["silhouette_agrees"]
    (folder,) = set(kept.glob("assigned-*")) - before
    assert spark.read.parquet(str(folder)).columns == ["prediction", "i", "x", "q"]


def test_sizes_are_shown_as_they_are(spark, tmp_path):
    def plain(size):
        power = 0
        while size >= 1024 and power < 4:
            size, power = size / 1024, power + 1
        return f"{size:.2f} {['B', 'KB', 'MB', 'GB', 'TB'][power]}" if size else "0 B"

    # From 1152 on each is an exact tie in KB; the ones before, but 0, would change if rounded down to a multiple of 128.
    sizes = [0, 1, 127, 129, 1023, 1100, 20_001, 128_657, *range(1152, 40_000, 256)]
    rows = [(i, "", "en", "s", n) for i, n in enumerate(sizes)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["format_file_size"](spark, str(tmp_path)).orderBy("doc_id").collect()
    columns = {"bytes": 1, "thousands": 10**3, "millions": 10**6, "huge": 10**12}
    assert [[r[c] for c in columns] for r in found] == [[plain(n * k) for k in columns.values()] for n in sizes]
