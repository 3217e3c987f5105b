"""The four tables as bucketed Parquet tables under one root."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doclake import schema
from doclake.functions import scalars as SC
from doclake.plans.paging import RankDirectory
from doclake.session import discard, exists, make_folder, read_text, settings, write_text, written

# Partitions are found by listing the folder, so what other sessions append is seen without a repair.
_LISTED = {"spark.sql.hive.manageFilesourcePartitions": "false"}


class TableStore:
    """Reads and appends the tables; creating them is idempotent.

    Each table is a folder below the root, known to the session's catalog as an external table. Its rows
    are in ``buckets`` buckets by the hash of its join key (``schema.BUCKET_BY``), so joins and anti-joins
    on these keys read bucket beside bucket and shuffle nothing. The number is fixed when the store is
    created and kept beside the tables. It is what the session shuffles into, unless given: a large store wants
    about one bucket for every GB of a table, a small one few, since each append writes a file per day and bucket.
    What a session appends is dealt to the buckets first: that is one shuffle of new rows instead of one
    of all keys for every later batch.

    Files and results are stored by day as well (``schema.DAY_OF``): reports of recent days read only these
    days' folders, and a change of flags rewrites only the days it concerns. Reading such a table
    gives the column ``day`` behind its own columns.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        kept = read_text(spark, f"{self.root}/_layout.json")
        if kept is None and exists(spark, f"{self.root}/files"):
            raise ValueError(f"the tables in {self.root} are of an earlier layout; append their rows to a new store")
        self.buckets = json.loads(kept)["buckets"] if kept else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._database = "doclake_" + hashlib.md5(f"{self.root} {self.buckets}".encode()).hexdigest()
        self._known: set[str] = set()

    def path(self, name: str) -> str:
        if name not in schema.TABLES:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def create_tables(self) -> "TableStore":
        """Create what is missing; existing rows stay."""
        if not exists(self.spark, f"{self.root}/_layout.json"):
            write_text(self.spark, f"{self.root}/_layout.json", json.dumps({"buckets": self.buckets}))
        for name in schema.TABLES:
            make_folder(self.spark, self.path(name))
            self.table(name)
        return self

    def table(self, name: str) -> str:
        """The name of the table in the session's catalog."""
        full, path = f"`{self._database}`.`{name}`", self.path(name)
        if name not in self._known:
            columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.TABLES[name].fields]
            by_day = ""
            if name in schema.DAY_OF:
                columns.append(f"`{schema.DAY}` date")
                by_day = f"PARTITIONED BY (`{schema.DAY}`)"
            with settings(self.spark, _LISTED):
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self._database}` LOCATION {_quoted(self.root + '/_catalog')}")
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({', '.join(columns)}) USING parquet {by_day} "
                               f"CLUSTERED BY (`{schema.BUCKET_BY[name]}`) INTO {self.buckets} BUCKETS LOCATION {_quoted(path)}")
            self._known.add(name)
        return full

    def read(self, name: str) -> DataFrame:
        self.spark.catalog.refreshTable(self.table(name))  # other sessions append as well
        return self.spark.table(self.table(name))

    def append(self, name: str, df: DataFrame) -> None:
        self._dealt(name, conform(df, name)).write.insertInto(self.table(name))

    def _dealt(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with their day, each bucket in one task."""
        if name in schema.DAY_OF:
            rows = rows.withColumn(schema.DAY, F.to_date(schema.DAY_OF[name]))
        return rows.repartition(self.buckets, schema.BUCKET_BY[name])

    def replace_days(self, name: str, df: DataFrame) -> None:
        """Put the rows in the place of all rows of their days; other days keep their files.

        ``df`` may read the table: it is written beside it first.
        """
        staged = written(conform(df, name), f"new-{name}")
        try:
            with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
                self._dealt(name, staged).write.insertInto(self.table(name), overwrite=True)
        finally:
            discard(staged)

    def set_processed(self) -> int:
        """Store the flag of every file whose text has been extracted; returns the number of files changed."""
        with_text = self.read("processed_data").select("file_id")
        return self._change_flags(self.read("files").where(~F.coalesce("processed", F.lit(False))).join(with_text, "file_id", "left_semi"),
                                  lambda files: mark_processed(files, with_text))

    def reset_processed(self) -> int:
        """Store all flags as not set, so that everything is processed again; returns the number of files changed."""
        return self._change_flags(self.read("files").where("processed"), reset_processed)

    def _change_flags(self, due: DataFrame, change) -> int:
        # One row per day with a change.
        days = due.groupBy(schema.DAY).agg(F.count("*").alias("n")).collect()
        if days:
            table = self.read("files")
            self.replace_days("files", change(table.where(_in_days([r[schema.DAY] for r in days]))))
        return sum(r["n"] for r in days)

    def ranks(self, name: str) -> RankDirectory:
        """The directory that leads from page numbers of the table, in the order of its key, to its rows."""
        return RankDirectory(self.spark, f"{self.root}/_ranks/{name}", schema.KEYS[name])

    def register(self) -> None:
        """Temporary views of all tables, for free SQL."""
        for name in schema.TABLES:
            self.read(name).createOrReplaceTempView(name)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in_days(days: list) -> Column:
    """Rows of these days; None stands for rows without a day."""
    known = F.col(schema.DAY).isin([d for d in days if d is not None])
    return known | F.col(schema.DAY).isNull() if None in days else known


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of the table in order; what the frame lacks is NULL, or made of what it has."""
    made = {"parsed_results": SC.parse_json_safe("results")} if "results" in df.columns else {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else made.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in schema.TABLES[name].fields
        ]
    )


def create_catalog_tables(spark: SparkSession, database: str = "default") -> None:
    """The same four tables in the session catalog, as managed Parquet tables."""
    for name, columns in schema.TABLES.items():
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def mark_processed(files: DataFrame, processed_data: DataFrame) -> DataFrame:
    """Files with ``processed`` set where extracted data exists; other flags stay."""
    done = processed_data.select("file_id").distinct().withColumn("_done", F.lit(True))
    flag = F.coalesce(F.col("_done"), F.col("processed"), F.lit(False))
    return files.join(done, "file_id", "left").withColumn("processed", flag).select(*files.columns)


def reset_processed(files: DataFrame) -> DataFrame:
    return files.withColumn("processed", F.lit(False))
