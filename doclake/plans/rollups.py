"""Reports from partial aggregates by day, kept beside the store's tables.

Every table stored by day has a rollup: counts and sums per day and the report's other columns. They merge by
addition, so a report adds up a few rows per day instead of reading the table. A day's partial is
worked out again when the folder of that day has other files than it was made from: after late rows, changed
flags, or new days. All other days are left alone. Where a report looks back to a point inside a day,
the rows of that day alone come from the table.

Counts are those of :mod:`doclake.plans.reporting`; averages are the same up to the order of their sums.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from doclake import schema
from doclake.plans import reporting as R
from doclake.session import exists, read_text, settings, write_text
from doclake.sources.tables import TableStore

DAY = schema.DAY
# table -> the columns that a rollup keeps beside the day
BY = {"files": ["file_type", "processed"], "analytics_results": [], "data_quality_metrics": ["check_type", "status"]}


def _measures(name: str, table: DataFrame) -> list[Column]:
    rows = F.count("*").alias("n")
    values: dict[str, Column] = {}
    if name == "files":
        values = {"size": F.col("file_size")}
    elif name == "analytics_results":
        values = {f: R.result_number(table, f) for f in ("word_count", "sentiment_score")} | {"confidence": F.col("confidence_score")}
    return [rows, *[a.alias(f"{v}_{kind}") for v, c in values.items() for kind, a in (("sum", F.sum(c)), ("n", F.count(c)))]]


class Rollups:
    """The rollups of a store. :meth:`refresh` brings them up to its tables; everything else reads them."""

    def __init__(self, store: TableStore):
        self.store, self.spark = store, store.spark

    def _folder(self, name: str) -> str:
        return f"{self.store.root}/_rollups/{name}"

    def refresh(self) -> dict[str, int]:
        """Work out the partials of all days that changed; returns the number of these days by table."""
        return {name: self._refresh(name) for name in BY}

    def _refresh(self, name: str) -> int:
        table = self.store.read(name)
        made_from = json.loads(read_text(self.spark, f"{self._folder(name)}.json") or "{}")
        files = _files_of_days(table.inputFiles())
        stale = sorted(day for day in files.keys() | made_from.keys() if files.get(day) != made_from.get(day))
        if not stale and exists(self.spark, self._folder(name)):
            return 0
        partial = table.where(_days(stale)).groupBy(DAY, *BY[name]).agg(*_measures(name, table))
        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            # One small file per day. The days are noted last: a run that dies in between is repeated.
            partial.repartition(DAY).write.mode("overwrite").partitionBy(DAY).parquet(self._folder(name))
        write_text(self.spark, f"{self._folder(name)}.json", json.dumps(files))
        return len(stale)

    def read(self, name: str) -> DataFrame:
        """One row per day and further columns: ``n`` rows, and sum and count of every value."""
        table = self.store.read(name)
        kinds = table.groupBy(*BY[name]).agg(*_measures(name, table)).schema
        return self.spark.read.schema(f"{_ddl(kinds)}, {DAY} date").parquet(self._folder(name))

    def recent(self, name: str, bound: Column, strict: bool = False) -> DataFrame:
        """Partials of the rows since a time. Only the rows of the bound's own day come from the table."""
        ts, table = schema.DAY_OF[name], self.store.read(name)
        edge = table.where((F.col(DAY) == F.to_date(bound)) & (F.col(ts) > bound if strict else F.col(ts) >= bound))
        edge = edge.groupBy(DAY, *BY[name]).agg(*_measures(name, table))
        return self.read(name).where(F.col(DAY) > F.to_date(bound)).unionByName(edge)

    # ---------------------------------------------------------------------- reports

    def files_scan(self) -> DataFrame:
        return self.read("files").agg(_sum("n").alias("total_files"), _sum("n", F.col("processed")).alias("processed_files"))

    def file_type_distribution(self) -> DataFrame:
        return self.read("files").groupBy("file_type").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "file_type")

    def file_type_stats(self) -> DataFrame:
        return self.read("files").groupBy("file_type").agg(F.sum("n").alias("count"), _average("size").alias("avg_size")).orderBy(F.desc("count"), "file_type")

    def pipeline_completion(self) -> DataFrame:
        done = F.sum(F.when(F.col("processed"), F.col("n")).when(F.col("processed").isNotNull(), 0))
        rate = F.coalesce(F.sum(F.when(F.col("processed"), F.col("n"))), F.lit(0)) / F.sum("n") * 100
        return self.read("files").agg(_sum("n").alias("total_files"), done.alias("processed_files"), rate.alias("completion_rate"))

    def upload_timeline(self, as_of: Column | None = None, days: int = 30) -> DataFrame:
        return self._per_day("files", "date", "uploads", as_of, days).orderBy("date")

    def quality_overview(self) -> DataFrame:
        return self.read("data_quality_metrics").groupBy("check_type", "status").agg(F.sum("n").alias("count"))

    def quality_score_overall(self) -> DataFrame:
        return self.read("data_quality_metrics").agg(*_score())

    def quality_score_by_check(self) -> DataFrame:
        return self.read("data_quality_metrics").groupBy("check_type").agg(*_score())

    def insight_averages(self) -> DataFrame:
        return self.read("analytics_results").agg(*_averages())

    def analytics_metrics(self, as_of: Column | None = None) -> DataFrame:
        active = self.recent("analytics_results", R._now(as_of) - F.make_dt_interval(F.lit(7))).agg(F.count_distinct(DAY)).scalar()
        return self.read("analytics_results").agg(*_averages(), _sum("n").alias("total_analyses")).withColumn("active_days", active)

    def recent_activity(self, as_of: Column | None = None, days: int = 7) -> DataFrame:
        return self._per_day("analytics_results", "date", "count", as_of, days).orderBy(F.desc("date"))

    def recent_runs(self, as_of: Column | None = None, days: int = 7) -> DataFrame:
        return self._per_day("analytics_results", "run_date", "records_processed", as_of, days).orderBy(F.desc("run_date"))

    def new_rows(self, name: str, column: str, hours: int = 1, as_of: Column | None = None) -> DataFrame:
        bound = R._now(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
        return self.recent(name, bound, strict=True).agg(_sum("n").alias(column))

    def summary_report(self, as_of: Column | None = None) -> DataFrame:
        return self.files_scan().select(
            R._now(as_of).alias("generated_at"), "total_files", R._rate("processed_files", "total_files").alias("processing_rate"),
            self.quality_score_overall().select("quality_score").scalar().alias("quality_score"))

    def processing_stats(self) -> DataFrame:
        """The analysed files are counted on the keys of the bucketed tables, since a file may span days."""
        analysed = R.analyzed_files(*[self.store.read(n) for n in ("files", "processed_data", "analytics_results")])
        return self.files_scan().select("total_files", "processed_files", analysed.scalar().alias("analyzed_files"),
                                        R._rate("processed_files", "total_files").alias("processing_rate"))

    def dashboard(self, as_of: Column | None = None) -> dict[str, DataFrame]:
        """The frames of :func:`doclake.plans.reporting.dashboard`."""
        return {
            "file_type_distribution": self.file_type_distribution(),
            "processing_stats": self.processing_stats(),
            "quality_overview": self.quality_overview(),
            "averages": self.insight_averages(),
            "recent_activity": self.recent_activity(as_of),
        }

    def pipeline_status(self, as_of: Column | None = None) -> dict[str, DataFrame]:
        return {"completion": self.pipeline_completion(), "recent_runs": self.recent_runs(as_of)}

    def _per_day(self, name: str, day: str, count: str, as_of: Column | None, days: int) -> DataFrame:
        rows = self.recent(name, R._now(as_of) - F.make_dt_interval(F.lit(days)))
        return rows.groupBy(F.col(DAY).alias(day)).agg(F.sum("n").alias(count))


def _files_of_days(files: list[str]) -> dict[str, str]:
    """Day -> a digest of the names of its files."""
    names = defaultdict(list)
    for f in files:
        day = re.search(rf"/{DAY}=([^/]+)/([^/]+)$", f)
        names[day[1]].append(day[2])
    return {day: hashlib.md5("\n".join(sorted(n)).encode()).hexdigest() for day, n in names.items()}


def _days(names: list[str]) -> Column:
    """Rows of the days with these folder names."""
    known = [n for n in names if not n.startswith("__")]
    found = F.col(DAY).isin([F.lit(n).cast("date") for n in known]) if known else F.lit(False)
    return found | F.col(DAY).isNull() if len(known) < len(names) else found


def _ddl(kinds) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)


def _sum(column: str, condition: Column | None = None) -> Column:
    value = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0))


def _average(value: str) -> Column:
    return F.try_divide(F.sum(f"{value}_sum").cast("double"), F.sum(f"{value}_n"))


def _averages() -> list[Column]:
    return [_average("word_count").alias("avg_word_count"), _average("sentiment_score").alias("avg_sentiment"),
            _average("confidence").alias("avg_confidence")]


def _score() -> list[Column]:
    good, total = _sum("n", F.col("status") == "good"), _sum("n")
    rate = F.when(total > 0, good / F.greatest(total, F.lit(1)) * 100).otherwise(0.0)
    return [total.alias("total_checks"), good.alias("passed_checks"), rate.alias("quality_score")]
