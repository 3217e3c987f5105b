"""Files of many formats to rows of ``files`` and ``processed_data``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from doclake.functions import fixed as X, scalars as SC, text as TX
from doclake.plans.reporting import upload_summary
from doclake.session import discard, written
from doclake.sources.documents import read_document
from doclake.sources.parts import PART_BYTES, plain_path, read_parts
from doclake.sources.tables import TableStore

# Categories whose files may need a Python reader; all others are plain expressions.
OFFICE = ["documents", "spreadsheets", "presentations"]
MAX_BYTES = 1 << 30  # of a file whose content is read as one value


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every file below a folder: path, modificationTime, length, content.

    The content of a file above ``max_bytes`` is null; it is never read. Files without a byte have an empty
    content, and no time: scans pass over them, only the listing of the folder has them.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = every.where(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    rows = every.where(F.col("length") <= max_bytes).unionAll(large)
    empty = _empty_files(every)
    return rows if empty is None else rows.unionByName(empty)


def _empty_files(every: DataFrame) -> DataFrame | None:
    """The files that a listing names and a scan does not; None without any. No content is read for it."""
    spark = every.sparkSession
    listed = spark.createDataFrame([(f,) for f in every.inputFiles()], "uri string")
    missed = listed.select(plain_path(F.col("uri")).alias("path")).join(every.select("path"), "path", "left_anti")
    found = written(missed, "empty-files")
    if found.isEmpty():
        discard(found)
        return None
    return found.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"),
                        F.lit(b"").alias("content"))


def read_csv_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV file as a table; large files are split between tasks. Pass a schema to read once."""
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def csv_text(text: Column) -> Column:
    """A CSV text with tabs between its cells and line feeds between its rows.

    Quotes around a cell go and doubled quotes become one; a quoted cell keeps its line feeds.
    """
    cells = F.regexp_extract_all(text, F.lit(r'("[^"]*+(?:""[^"]*+)*+"|[^,\r\n]*)(,|\r\n?|\n|\z)'), F.lit(0))

    def shown(cell: Column) -> Column:
        end = F.regexp_extract(cell, r"(,|\r\n?|\n|)\z", 1)
        body = F.substring(cell, F.lit(1), F.length(cell) - F.length(end))
        quoted = body.startswith('"') & body.endswith('"') & (F.length(body) > 1)
        plain = F.replace(F.substring(body, F.lit(2), F.length(body) - 2), F.lit('""'), F.lit('"'))
        return F.concat(F.when(quoted, plain).otherwise(body), F.when(end == ",", "\t").when(end == "", "").otherwise("\n"))

    return F.array_join(F.transform(cells, shown), "")


def image_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text (format, size, colour mode) of every image below a folder that can be decoded."""
    names = ",".join(e[1:] + "," + e[1:].upper() for e in X.FILE_CATEGORIES["images"])
    found = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{names}}}").load(path)
    origin = plain_path(F.col("image.origin"))  # other sources give plain paths
    kind = F.replace(F.replace(F.upper(F.regexp_extract("path", "[.]([^.]+)$", 1)), F.lit("JPG"), F.lit("JPEG")), F.lit("TIFF"), F.lit("TIF"))
    mode = F.when(F.col("channels") == 1, "L").when(F.col("channels") == 4, "RGBA").otherwise("RGB")
    return found.select(origin.alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                        F.col("image.nChannels").alias("channels")).where("width > 0").select(
        "path", F.format_string("Image: %s, Size: (%d, %d), Mode: %s", F.replace(kind, F.lit("TIF"), F.lit("TIFF")), "width", "height", mode).alias("text"))


def file_id() -> Column:
    return SC.stable_id("path", "modificationTime", "length")


def ingest_files(raw: DataFrame, source_type: str = "upload", as_of: Column | None = None) -> DataFrame:
    """Rows for ``files`` from ``binaryFile`` rows.

    The id depends on path, time and length, so a recomputed task gives the same id and the
    extracted text still finds its file.
    """
    name = F.element_at(F.split("path", "/"), -1)
    extension = SC.file_extension(name)
    return raw.select(
        file_id().alias("file_id"),
        name.alias("filename"),
        extension.alias("file_type"),
        F.col("length").alias("file_size"),
        F.lit(source_type).alias("source_type"),
        (F.current_timestamp() if as_of is None else as_of).alias("upload_date"),
        F.lit(False).alias("processed"),
        "content",
        F.to_json(F.struct(
            extension.alias("file_extension"), F.col("length").alias("file_size"),
            F.lit(source_type).alias("source_type"), SC.file_category(extension).alias("file_type"),
        )).alias("metadata"),
    )


READ = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "status", "error")])


@F.pandas_udf(READ)
def _read(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if c is None else read_document(e, c) for e, c in zip(extension, content)]
    return pd.DataFrame(rows, columns=["text", "status", "error"])


def extract_content(files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """file_id, content_type, extracted_text, extract_status, extract_error of every file.

    One scan: plain text, CSV, media and archives stay in the JVM, and only the bytes of
    office files are handed to Python. ``images`` (file_id, text) says what was decoded of
    images; those it does not list, and all without it, are errors.
    """
    kind, content, extension = F.col("content_type"), F.col("content"), F.col("file_type")
    is_csv = extension == ".csv"
    in_python = kind.isin(OFFICE) & ~is_csv
    as_text = (kind == "text") | is_csv
    typed = files.select("file_id", "file_type", "content", SC.file_category("file_type").alias("content_type"))
    read = typed.withColumn("_r", _read("file_type", F.when(in_python, content)))
    if images is None:
        read = read.withColumn("_image", F.lit(None).cast("string"))
    else:
        read = read.join(images.select("file_id", F.col("text").alias("_image")), "file_id", "left")
    decoded = F.try_validate_utf8(content.cast("string"))
    text = (
        F.when(in_python, F.col("_r.text"))
        .when(is_csv, csv_text(decoded))
        .when(kind == "text", decoded)
        .when(kind == "images", F.col("_image"))
        .when(kind == "audio", X.AUDIO_TEXT)
        .when(kind == "video", X.VIDEO_TEXT)
        .otherwise("")
    )
    error = (
        F.when((in_python | as_text) & content.isNull(), "no content, or more than can be read as one value")
        .when(in_python, F.col("_r.error"))
        .when(as_text & decoded.isNull(), "not valid UTF-8")
        .when((kind == "images") & F.col("_image").isNull(), "cannot decode the image")
    )
    status = F.when(in_python & content.isNotNull(), F.col("_r.status")).when(error.isNotNull(), "error").otherwise("ok")
    return read.select(
        "file_id", "content_type", text.alias("extracted_text"), status.alias("extract_status"),
        error.alias("extract_error"),
    )


def has_parts(max_bytes: int = MAX_BYTES) -> Column:
    """Whether a row of ``files`` is a text or CSV file that is read in parts."""
    return (F.col("file_size") > max_bytes) & ((SC.file_category("file_type") == "text") | (F.col("file_type") == ".csv"))


def extract_parts(files: DataFrame, paths: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """What :func:`extract_content` gives, and ``part``, of text and CSV files above the limit.

    ``files``: their rows; ``paths``: file_id and path. A file gives one row per part, in the order of
    ``part``; the texts of its parts, put together, are its text, and a word or a CSV record is never cut.
    """
    due = files.select("file_id", "file_type", SC.file_category("file_type").alias("content_type")).join(paths, "file_id")
    due = due.select("path", "file_id", "file_type", "content_type").collect()  # one row per file above the limit
    spark = files.sparkSession
    rows = spark.createDataFrame([tuple(r) for r in due], "path string, file_id string, file_type string, content_type string")
    if not due:
        return rows.select("file_id", "content_type", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("extracted_text", "string"), ("extract_status", "string"), ("extract_error", "string"), ("part", "long"))])
    is_csv = F.lower(F.substring("path", -4, 4)) == ".csv"
    parts = read_parts(spark, [r["path"] for r in due], is_csv, part_bytes).join(rows, "path")
    text = F.when(is_csv, csv_text(F.col("extracted_text"))).otherwise(F.col("extracted_text"))
    return parts.select("file_id", "content_type", text.alias("extracted_text"),
                        F.when(F.col("extract_error").isNull(), "ok").otherwise("error").alias("extract_status"), "extract_error", "part")


def processed_rows(extracted: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows for ``processed_data``; failed extractions give none. A part of a file is a row of its own."""
    text = "extracted_text"
    data_id = SC.stable_id("file_id", prefix="data")
    if "part" in extracted.columns:
        data_id = F.when(F.col("part").isNull(), data_id).otherwise(SC.stable_id("file_id", "part", prefix="data"))
    return extracted.where(F.col("extract_status") == "ok").select(
        data_id.alias("data_id"), "file_id", "content_type", text,
        TX.word_count(text).alias("word_count"), TX.char_count(text).alias("char_count"),
        (F.current_timestamp() if as_of is None else as_of).alias("processing_date"),
    )


def extraction_results(extracted: DataFrame) -> DataFrame:
    """What an upload answers per file: type, preview, counts, status."""
    text = "extracted_text"
    return extracted.select(
        "file_id", "content_type", TX.preview(text, 1000).alias("extracted_text"),
        TX.word_count(text).alias("word_count"), TX.char_count(text).alias("char_count"),
        "extract_status", "extract_error",
    )


def ingest(store: TableStore, path: str, source_type: str = "upload", as_of: Column | None = None,
           max_bytes: int = MAX_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Ingest a folder into the store; returns the number of files per status.

    Texts are written first and ``files`` rows, with their processed flag, last. Files that
    are already in the store are left alone, so an interrupted run can be repeated. A text or CSV
    file above ``max_bytes`` has a row of ``processed_data`` for each of its parts.

    Which files are new, and which of them failed, are narrow tables written first, so that the planner
    knows their size and broadcasts them to the content scan. Contents are shuffled once, by the store.
    """
    raw = read_files(store.spark, path, max_bytes)
    new, parts = ingest_files(raw, source_type, as_of), []
    paths = raw.select(file_id().alias("file_id"), "path")
    images = image_texts(store.spark, path).join(paths, "path").select("file_id", "text")
    known = store.read("files").select("file_id")
    if not known.isEmpty():
        ids = written(new.select("file_id").join(known, "file_id", "left_anti"), "new-files")
        parts.append(ids)
        new = new.join(ids, "file_id", "left_semi")
    whole = extract_content(new.where(~has_parts(max_bytes)), images).withColumn("part", F.lit(None).cast("long"))
    extracted = written(whole.unionByName(extract_parts(new.where(has_parts(max_bytes)), paths, part_bytes)), "extracted")
    failed = written(extracted.where(F.col("extract_status") != "ok").select("file_id"), "failed-files")
    parts += [extracted, failed]
    try:
        texts = processed_rows(extracted, as_of)
        have = store.read("processed_data").select("data_id").join(texts.select("data_id"), "data_id", "left_semi")
        store.append("processed_data", texts.join(have, "data_id", "left_anti"))
        flagged = new.drop("processed").join(failed.withColumn("_failed", F.lit(True)), "file_id", "left")
        store.append("files", flagged.withColumn("processed", F.col("_failed").isNull()))
        summary = upload_summary(extracted.where("part IS NULL OR part = 0")).collect()  # one row per status
        return store.spark.createDataFrame(summary, "extract_status string, count long")
    finally:
        for part in parts:
            discard(part)
