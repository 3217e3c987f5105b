"""Incremental ETL: every document is analysed once, as soon as its text and its processed file are both there."""

from __future__ import annotations

import datetime as dt
import json
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from doclake import schema
from doclake.operators import etl
from doclake.session import discard, read_text, settings, write_text, written
from doclake.sources.tables import TableStore

# State of the documents that wait is kept in a store that spills, with a changelog in the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_FILE = "filename string, file_type string"
_PLACE = "data_id string, path string, row long"  # of a text: its file in the store, and its row there
ARRIVAL = DUE = f"file_id string, {_FILE}, {_PLACE}"  # an arriving file has no data_id, an arriving text no file's columns
_due = Row(*[c.split()[0] for c in DUE.split(", ")])
LISTED = 64  # texts of a file that are remembered in one value; a file with more has an entry for each


class _Partners(StatefulProcessor):
    """Per file id: the processed file once it is known, the places of texts that wait for it, and which texts are done.

    The usual file, of few texts, costs one read and one write of its state in a batch.
    """

    def __init__(self, listed: int):
        self.listed = listed

    def init(self, handle) -> None:
        self.value = handle.getValueState("file", f"known boolean, {_FILE}, done array<string>")
        self.waiting = handle.getListState("waiting", _PLACE)
        self.more = handle.getMapState("done", "data_id string", "seen boolean")

    def _first(self, data_id: str, done: list) -> bool:
        """Whether the text is new; it is remembered."""
        if data_id in done or (len(done) >= self.listed and self.more.containsKey((data_id,))):
            return False
        if len(done) < self.listed:
            done.append(data_id)
        else:
            self.more.updateValue((data_id,), (True,))
        return True

    def handleInputRows(self, key, rows, timerValues):
        known, *file, done = self.value.get() or (None, None, None, [])
        before, done, wait, changed = known, list(done), [], False
        for r in rows:
            if r.data_id is None:
                known, file, changed = True, (r.filename, r.file_type), True
            elif self._first(r.data_id, done):
                changed = True
                if known:
                    yield _due(key[0], *file, r.data_id, r.path, r.row)
                else:  # its file may come later in this batch: the order of rows says nothing
                    wait.append((r.data_id, r.path, r.row))
        if known:
            if not before and self.waiting.exists():
                yield from (_due(key[0], *file, *place) for place in self.waiting.get())
                self.waiting.clear()
            yield from (_due(key[0], *file, *place) for place in wait)
        elif wait:
            self.waiting.appendList(wait)
        if changed:
            self.value.update((known, *file, done))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        known, *file, done = self.value.get() or (None, None, None, [])
        done = list(done)
        if self._first(initialState.data_id, done):
            self.value.update((known, *file, done))

    def close(self) -> None:
        pass


def arrivals(store: TableStore, files_per_batch: int | None = None) -> DataFrame:
    """Rows of ``processed_data`` and processed ``files`` as they are appended, as one stream of narrow rows."""

    def stream(name: str) -> DataFrame:
        reader = store.spark.readStream.schema(schema.TABLES[name])
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(store.path(name))

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    texts = stream("processed_data").select("file_id", "data_id", "_metadata.file_path", "_metadata.row_index").where(
        "file_id IS NOT NULL AND data_id IS NOT NULL").select(
        "file_id", none("string").alias("filename"), none("string").alias("file_type"), "data_id", F.col("file_path").alias("path"), F.col("row_index").alias("row"))
    files = stream("files").where("processed AND file_id IS NOT NULL").select(
        "file_id", "filename", "file_type", none("string").alias("data_id"), none("string").alias("path"), none("long").alias("row"))
    return texts.unionAll(files)


def with_texts(due: DataFrame) -> DataFrame:
    """The texts at the places of the due rows; only the files that hold some are read."""
    spark = due.sparkSession
    paths = [unquote(r["path"]) for r in due.select("path").distinct().collect()]
    texts = spark.read.schema(schema.PROCESSED_DATA).parquet(*paths)
    texts = texts.select("content_type", "extracted_text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    return texts.join(due, ["path", "row"]).select("file_id", "filename", "file_type", "data_id", "content_type", "extracted_text")


def incremental_etl(store: TableStore, checkpoint: str, as_of: Column | None = None,
                    files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Keep the analytics tables up to date as ``processed_data`` and ``files`` grow.

    A batch reads the keys that arrived, its state, and the texts that are due: a text that comes before its
    file's row, or whose file is marked processed later, waits and is analysed by the batch of that row. The state
    holds the place of such a text in the store, so texts are neither copied into it nor handed to Python. What the store
    has analysed before the stream's first batch is its initial state. A document that arrives twice is looked at
    once; one whose text is NULL has nothing to analyse.

    A batch that is run again after a failure repeats its rows and its time of creation, which are both in
    the checkpoint; only then are rows that it had already stored looked up, in the folder of that day.
    The checkpoint belongs to this query: one of an older, stateless version cannot be continued.
    """
    spark, checkpoint = store.spark, checkpoint.rstrip("/")

    def analyse(batch: DataFrame, batch_id: int) -> None:
        mark = f"{checkpoint}/stored/{batch_id}.json"
        begun = json.loads(read_text(spark, mark) or "null")
        due = written(batch, "due")  # in any case: this is what brings the state forward
        try:
            if (begun and begun["ended"]) or due.isEmpty():
                return
            at = begun["at"] if begun else dt.datetime.now(dt.timezone.utc).isoformat()
            if not begun:
                write_text(spark, mark, json.dumps({"at": at, "ended": False}))
            now = F.lit(at).cast("timestamp") if as_of is None else as_of
            transformed = written(etl.etl_transform(with_texts(due)), "etl")
            try:
                _store(store, transformed, now, again=bool(begun))
            finally:
                discard(transformed)
            write_text(spark, mark, json.dumps({"at": at, "ended": True}))
        finally:
            discard(due)

    analysed = store.read("analytics_results").select("data_id").join(
        store.read("processed_data").select("data_id", "file_id"), "data_id").where("file_id IS NOT NULL")
    due = arrivals(store, files_per_batch).groupBy("file_id").transformWithState(
        _Partners(LISTED), DUE, "Append", "None", initialState=analysed.groupBy("file_id"))
    writer = due.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    with settings(spark, STATE):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def _store(store: TableStore, transformed: DataFrame, now: Column, again: bool) -> None:
    """Append metrics and analytics of one batch; ``again``: some of them may be there from a first attempt."""
    for name, rows in (("data_quality_metrics", etl.quality_rows(transformed, now)), ("analytics_results", etl.analytics_rows(transformed, now))):
        if again:
            key = schema.KEYS[name]
            there = store.read(name).where(F.col(schema.DAY) == F.to_date(now)).select(key)
            rows = rows.join(there, key, "left_anti")
        store.append(name, rows)
