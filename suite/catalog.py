"""Registered queries: a name, the Spark job, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from doclake.functions import fixed as X
from doclake.session import shared_folder
from doclake.sources.tables import TableStore
from suite.derived import AS_OF, load, view, with_views


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Given and derived tables of one scale, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str, hosts: int = 1):
        self.spark, self.sf_dir, self.hosts = spark, sf_dir, hosts

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("files", "processed_data", "analytics_results", "data_quality_metrics", "site_pages"):
            return view(self.spark, self.sf_dir, name, self.hosts)
        return load(self.spark, self.sf_dir, name, spread=name == "pages")


def query(name: str, sql: str | None = None, hosts: int = 1):
    """Register ``fn(tables) -> DataFrame`` under a name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from doclake.session import configure

            return fn(Tables(configure(spark), sf_dir, hosts))

        QUERIES[name] = Query(run, with_views(sql, hosts) if sql else None)
        return fn

    return register


def filled_store(t: Tables, *names: str) -> TableStore:
    """A new store in the shared folder, holding the derived tables."""
    store = TableStore(t.spark, f"{shared_folder(t.spark)}/doclake/store-{uuid.uuid4().hex}", buckets=8).create_tables()
    for name in names:
        store.append(name, getattr(t, name))
    return store


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; compare them to ``digits`` places."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------- SQL building blocks

NOW = f"TIMESTAMP '{AS_OF}'"


# Class bodies in the checking engine's regex dialect.
WS = "".join(f"\\x{{{ord(c):x}}}" for c in X.WHITESPACE_CHARS)
LB = "".join(f"\\x{{{c:x}}}" for c in (10, 13, 11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029))
ALL_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in X.WHITESPACE_CHARS) + ")"
WORDS = f"regexp_extract_all(extracted_text, '[^{WS}]+')"
N_SENT = "CAST(len(list_filter(string_split(extracted_text, '.'), lambda s: trim(s, {ws}) <> '')) AS INT)".format(ws=ALL_WS)


def count_of(pattern: str, text: str = "extracted_text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Documents with a text, and their words.
TEXTS = f"""texts AS (
 SELECT *, {WORDS} AS w, len({WORDS}) AS n, length(extracted_text) AS c, {N_SENT} AS s
 FROM processed_data WHERE extracted_text IS NOT NULL)"""
