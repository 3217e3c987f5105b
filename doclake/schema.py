"""The four tables of the data model."""

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TS, B, BIN, V = T.TimestampType(), T.BooleanType(), T.BinaryType(), T.VariantType()

FILES = _table(
    ("file_id", S), ("filename", S), ("file_type", S), ("file_size", L), ("source_type", S),
    ("upload_date", TS), ("processed", B), ("content", BIN), ("metadata", S),
)
PROCESSED_DATA = _table(
    ("data_id", S), ("file_id", S), ("content_type", S), ("extracted_text", S), ("word_count", I),
    ("char_count", I), ("file_metadata", S), ("processing_date", TS), ("quality_score", D),
)
ANALYTICS_RESULTS = _table(
    ("analysis_id", S), ("data_id", S), ("analysis_type", S), ("results", S), ("insights", S),
    ("confidence_score", D), ("created_date", TS),
    ("parsed_results", V),  # ``results``, parsed once when the row is stored
)
DATA_QUALITY_METRICS = _table(
    ("metric_id", S), ("file_id", S), ("check_type", S), ("check_value", D), ("threshold", D),
    ("status", S), ("check_date", TS),
)

TABLES = {
    "files": FILES,
    "processed_data": PROCESSED_DATA,
    "analytics_results": ANALYTICS_RESULTS,
    "data_quality_metrics": DATA_QUALITY_METRICS,
}
KEYS = {
    "files": "file_id",
    "processed_data": "data_id",
    "analytics_results": "analysis_id",
    "data_quality_metrics": "metric_id",
}
# child table -> (column, parent table)
PARENTS = {
    "processed_data": ("file_id", "files"),
    "analytics_results": ("data_id", "processed_data"),
    "data_quality_metrics": ("file_id", "files"),
}
# table -> the time by whose day its rows are stored, as partition column ``day``
DAY = "day"
DAY_OF = {"files": "upload_date", "analytics_results": "created_date", "data_quality_metrics": "check_date"}
# table -> the column by whose hash its rows are stored in buckets: joins on it need no shuffle
BUCKET_BY = {
    "files": "file_id",
    "processed_data": "data_id",
    "analytics_results": "data_id",
    "data_quality_metrics": "file_id",
}
