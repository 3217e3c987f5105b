"""Free SQL, paging and export over any table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from doclake.plans.paging import RankDirectory


def free_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, args=None) -> DataFrame:
    """Run one read-only statement over the given frames and the session catalog."""
    body = query.strip().rstrip(";").strip()
    bare = re.sub(r"(?s)'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", body)
    if not re.match(r"(?i)\s*(select|with|show|describe|desc)\b", bare):
        raise ValueError("only SELECT, WITH, SHOW and DESCRIBE statements are run")
    if re.search(r"(?i)\b(insert\s+(into|overwrite)|merge\s+into|delete\s+from|update\s+\w+\s+set)\b", bare):
        raise ValueError("the statement would change data")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    # Spark parses exactly one statement and rejects anything behind a semicolon.
    return spark.sql(body, args=args)


def list_tables(spark: SparkSession) -> DataFrame:
    return free_sql(spark, "SHOW TABLES")


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    return free_sql(spark, f"DESCRIBE `{table.replace('`', '``')}`")


def without_binary(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.BinaryType)])


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return without_binary(df).orderBy(key).limit(n)


def page_rows(df: DataFrame, key: str, page: int = 0, size: int = 10, ranks: RankDirectory | None = None) -> DataFrame:
    """Page ``page`` (from 0) of the table in key order.

    Without ``ranks`` all rows before the page are sorted as well; with the table's rank directory, which has to be
    up to date, one range of keys and the rows of the page are read, whatever the number of the page.
    """
    shown = without_binary(df)
    return shown.orderBy(key).offset(page * size).limit(size) if ranks is None else ranks.page(shown, page, size)


def page_after(df: DataFrame, key: str, last_key, size: int = 10) -> DataFrame:
    """The page after ``last_key``: the scan skips earlier rows instead of sorting them."""
    return without_binary(df).where(F.col(key) > F.lit(last_key)).orderBy(key).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    rows = F.count("*")
    return df.agg(rows.alias("row_count"), F.ceil(rows / size).cast("bigint").alias("total_pages"))


def table_profile(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """Columns, row count and the first rows of a table."""
    columns = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields],
        "column string, type string, nullable boolean",
    )
    return {"columns": columns, "row_count": df.agg(F.count("*").alias("row_count")), "sample": sample_rows(df, key)}


def page_table(df: DataFrame, key: str, page: int = 0, size: int = 10, ranks: RankDirectory | None = None) -> dict[str, DataFrame]:
    pages = page_count(df, size) if ranks is None else ranks.page_count(size)
    return {"rows": page_rows(df, key, page, size, ranks), "pages": pages}


def _printable(df: DataFrame) -> DataFrame:
    """CSV has neither bytes nor nested values: bytes as base64, the rest as JSON."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(c)
        shown.append(c.alias(f.name))
    return df.select(*shown)


def export_csv(df: DataFrame, path: str) -> None:
    """The whole table as CSV part files with headers, written in parallel."""
    _printable(df).write.option("header", True).option("escape", '"').csv(path)


def export_page_csv(df: DataFrame, key: str, path: str, page: int = 0, size: int = 10, ranks: RankDirectory | None = None) -> None:
    export_csv(page_rows(df, key, page, size, ranks), path)
