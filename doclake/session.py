"""Session settings and intermediate tables.

Nothing here starts a session behind the caller's back: operators work on the session of
the frames they get.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Documents and pages are wide rows, so Arrow batches are kept short: 256 rows of 1 MB
# are 256 MB in a Python worker, where the default of 10 000 rows would be 10 GB.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins of narrow keys with wide texts hash the keys instead of sorting the texts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings above and give the package to the Python workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="doclake-"), "doclake")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "doclake"))
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Without ``spark.checkpoint.dir`` it is a folder of the warehouse, which a session's
    executors share as well. The rule is the same for every master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_doclake"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scopes: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder.

    Readers see plain files: lineage is cut, lost executors cost nothing, and each later
    use reads only the columns it names.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/doclake/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Deletes at its end every table that :func:`written` made inside it.

    Operators whose lazy result still reads such tables (crawl, clusters, forest) leave them to
    the caller, who uses the result inside the block.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block."""
    old = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _at(spark: SparkSession, name: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, system = _at(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path, system = _at(spark, name)
    return system.exists(path)


def make_folder(spark: SparkSession, folder: str) -> None:
    path, system = _at(spark, folder)
    system.mkdirs(path)


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file of settings beside tables."""
    path, system = _at(spark, name)
    out = system.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, name: str) -> str | None:
    """The text of a small file; None where there is none."""
    if not exists(spark, name):
        return None
    path, system = _at(spark, name)
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`written` returned and nobody reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles() if "/doclake/" in f}:
        _delete(df.sparkSession, folder)
