"""Text measures, quality checks, ETL, and scalar helpers."""

import io
import uuid
import zipfile
from urllib.parse import unquote
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from doclake.functions import fixed as X, scalars as SC, text as TX, urls as U
from doclake.operators import etl, quality as Q, sentiment
from doclake.plans import reporting as R
from doclake.session import shared_folder
from doclake.sources import ingest as I
from doclake.sources.parts import read_parts
from suite.catalog import ALL_WS, LB, NOW, TEXTS, WS, Tables, as_of, count_of, filled_store, query, rounded, sql_list

T = "extracted_text"


def texts(t: Tables):
    return t.processed_data.where(F.col(T).isNotNull())


def measured(name: str, column, sql: str):
    """One measure of every text."""

    @query(name, f"WITH {TEXTS} SELECT data_id, {sql} AS {name} FROM texts")
    def _(t):
        return texts(t).select("data_id", column().alias(name))


# ------------------------------------------------------------------------- text measures

ALNUM = r"\p{L}\p{N}"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"
PER_CHAR = "greatest(c, 1)"
POS, NEG = sql_list(X.POSITIVE_WORDS), sql_list(X.NEGATIVE_WORDS)
RULE_POS, RULE_NEG = sql_list(X.RULE_POSITIVE_WORDS), sql_list(X.RULE_NEGATIVE_WORDS)
LOWER_WORDS = "list_transform(w, lambda x: lower(x))"


def hits(words: str, listed: str) -> str:
    return f"len(list_filter({words}, lambda x: list_contains({listed}, x)))"


WORD_COUNT = "CAST(n AS INT)"
CHAR_COUNT = "CAST(c AS INT)"
SENTIMENT = f"({hits(LOWER_WORDS, POS)} - {hits(LOWER_WORDS, NEG)}) / greatest(n, 1)"
READABILITY = "CASE WHEN n = 0 OR s = 0 THEN 0.0 ELSE greatest(0.0, 100 - n / s) END"
HAS_NUMBERS = f"regexp_matches({T}, '{DIGIT}')"
HAS_SPECIAL = f"regexp_matches({T}, '[^{ALNUM}]')"
AVG_WORD = "length(array_to_string(w, '')) / greatest(n, 1)"
CAPITAL = f"{count_of(r'\p{Lu}')} / {PER_CHAR}"
DIGITS = f"{count_of(DIGIT)} / {PER_CHAR}"
SPECIAL = f"{count_of(f'[^{ALNUM}{WS}]')} / {PER_CHAR}"
UNIQUE = "len(list_distinct(w)) / greatest(n, 1)"

measured("word_count", lambda: TX.word_count(T), WORD_COUNT)
measured("char_count", lambda: TX.char_count(T), CHAR_COUNT)
measured("sentence_count", lambda: TX.sentence_count(T), "s")
measured("text_preview_dots", lambda: TX.preview_with_dots(T), f"concat(left({T}, 200), '...')")
measured("text_preview", lambda: TX.preview(T, 1000),
         f"CASE WHEN c > 1000 THEN concat(left({T}, 1000), '...') ELSE {T} END")
measured("clean_text", lambda: TX.clean_text(T), f"""
array_to_string(list_filter(list_transform(regexp_split_to_array({T}, '[{LB}]|  '), lambda x: trim(x, {ALL_WS})),
 lambda x: x <> ''), ' ')""")
measured("sentiment_score", lambda: TX.sentiment_score(T), SENTIMENT)
measured("readability", lambda: TX.readability_score(T), READABILITY)
measured("unique_word_ratio", lambda: TX.unique_word_ratio(T), UNIQUE)


@query("valid_texts", f"SELECT data_id FROM processed_data WHERE length(trim({T}, {ALL_WS})) > 50")
def _(t):
    return TX.valid_texts(t.processed_data).select("data_id")


@query("basic_analytics", f"""WITH {TEXTS} SELECT data_id, {WORD_COUNT} AS word_count, {CHAR_COUNT} AS char_count,
 s AS sentence_count, {SENTIMENT} AS sentiment_score, {READABILITY} AS readability_score FROM texts""")
def _(t):
    return TX.with_words(texts(t)).select("data_id", TX.basic_analytics(T, "_words").alias("a")).select("data_id", "a.*")


@query("engineer_features", f"""WITH {TEXTS} SELECT data_id, {HAS_NUMBERS} AS has_numbers,
 {HAS_SPECIAL} AS has_special_chars, {AVG_WORD} AS avg_word_length, {CAPITAL} AS capital_ratio FROM texts""")
def _(t):
    return TX.with_words(texts(t)).select("data_id", TX.engineered_features(T, "_words").alias("f")).select("data_id", "f.*")


@query("char_class_ratios", f"""WITH {TEXTS} SELECT data_id, {CAPITAL} AS capital_ratio, {DIGITS} AS digit_ratio,
 {SPECIAL} AS special_char_ratio FROM texts""")
def _(t):
    return texts(t).select(
        "data_id", TX.capital_ratio(T).alias("capital_ratio"), TX.digit_ratio(T).alias("digit_ratio"),
        TX.special_char_ratio(T).alias("special_char_ratio"),
    )


@query("ml_features", f"""WITH {TEXTS} SELECT data_id, CAST(n AS DOUBLE) AS word_count, CAST(c AS DOUBLE) AS char_count,
 CAST(s AS DOUBLE) AS sentence_count, {AVG_WORD} AS avg_word_length, {UNIQUE} AS unique_word_ratio,
 {CAPITAL} AS capital_ratio, {DIGITS} AS digit_ratio, {SPECIAL} AS special_char_ratio FROM texts""")
def _(t):
    return TX.ml_features(t.processed_data)


RULES = f"""rules AS (SELECT data_id, CAST(p + q AS INT) AS total, p, q FROM (
 SELECT data_id, {hits(f'list_distinct({LOWER_WORDS})', RULE_POS)} AS p,
  {hits(f'list_distinct({LOWER_WORDS})', RULE_NEG)} AS q FROM texts)),
scored AS (SELECT data_id, CASE WHEN total = 0 THEN 0.0 ELSE (p - q) / total END AS sentiment FROM rules)"""
CONFIDENCE = "least(abs(sentiment) * 2, 1.0)"


@query("rule_sentiment", f"WITH {TEXTS}, {RULES} SELECT data_id, sentiment, {CONFIDENCE} AS confidence FROM scored")
def _(t):
    return sentiment.rule_based_sentiment(t.processed_data)


@query("sentiment_summary", f"""WITH {TEXTS}, {RULES} SELECT round(avg(sentiment), 6) AS avg_sentiment,
 round(avg({CONFIDENCE}), 6) AS avg_confidence FROM scored""")
def _(t):
    return rounded(
        R.sentiment_summary(sentiment.rule_based_sentiment(t.processed_data)), "avg_sentiment", "avg_confidence"
    )


@query("sentiment_histogram", f"""WITH {TEXTS}, {RULES}
SELECT CAST(least(floor((sentiment + 1) / 2 * 20), 19) AS INT) AS bin, count(*) AS count FROM scored GROUP BY 1""")
def _(t):
    return R.sentiment_histogram(sentiment.rule_based_sentiment(t.processed_data))


@query("insight_text", f"WITH {TEXTS} SELECT data_id, concat('Processed file with ', n, ' words') AS insight FROM texts")
def _(t):
    return texts(t).select("data_id", TX.insight_text(TX.word_count(T)).alias("insight"))


# -------------------------------------------------------------------------- quality checks

COMPLETENESS = ("CASE WHEN {t} IS NULL OR n = 0 THEN 0.0 WHEN n < 10 THEN 0.3 WHEN n < 50 THEN 0.6 ELSE 0.9 END",
                "CASE WHEN {t} IS NULL OR n = 0 THEN 'failed' WHEN n < 10 THEN 'poor' WHEN n < 50 THEN 'fair' ELSE 'good' END")
INVALID = " + ".join(f"len(string_split({T}, {m})) - 1" for m in ("chr(65533)", "'NULL'", "'undefined'"))
VALID_SCORE = f"CASE WHEN c > 1000000 THEN 0.2 ELSE greatest(0.0, 1 - ({INVALID}) / greatest(n, 1)) END"
SAME = "coalesce(file_type, '') = coalesce(content_type, '')"
# check -> (value, status) over texts joined to their files
CHECKS = {
    "completeness": tuple(x.format(t=T) for x in COMPLETENESS),
    "validity": (VALID_SCORE, f"CASE WHEN c <= 1000000 AND {VALID_SCORE} > 0.8 THEN 'good' ELSE 'poor' END"),
    "consistency": (f"CASE WHEN {SAME} THEN 0.9 ELSE 0.5 END", f"CASE WHEN {SAME} THEN 'good' ELSE 'fair' END"),
    "uniqueness": (UNIQUE, f"CASE WHEN {UNIQUE} > 0.7 THEN 'good' ELSE 'fair' END"),
    "accuracy": ("0.8", "'good'"),
}
DOCS = f"""{TEXTS}, docs AS (SELECT t.*, f.file_type, f.file_size FROM texts t JOIN files f ON f.file_id = t.file_id)"""


def checked(source: str = "docs") -> str:
    return " UNION ALL ".join(
        f"SELECT data_id, file_id, '{name}' AS check_type, CAST({v} AS DOUBLE) AS check_value, {s} AS status FROM {source}"
        for name, (v, s) in CHECKS.items()
    )


def docs(t: Tables):
    return etl.join_files_processed(t.files.select("file_id", "file_type", "file_size"), t.processed_data)


@query("quality_checks", f"""WITH {DOCS} {checked()}
UNION ALL SELECT data_id, file_id, unnest(['completeness', 'error']), 0.0, 'failed' FROM processed_data
WHERE {T} IS NULL""")
def _(t):
    return Q.quality_checks(docs(t))


def one_check(name: str, column):
    value, status = CHECKS[name]

    @query(name, f"WITH {DOCS} SELECT data_id, CAST({value} AS DOUBLE) AS value, {status} AS status FROM docs")
    def _(t):
        return docs(t).where(F.col(T).isNotNull()).select("data_id", column().alias("q")).select("data_id", "q.*")


one_check("completeness", lambda: Q.completeness(T))
one_check("validity", lambda: Q.validity(T))
one_check("consistency", lambda: Q.consistency("file_type", "content_type"))
one_check("uniqueness", lambda: Q.uniqueness(T))
one_check("accuracy", Q.accuracy)


@query("quality_error", f"""
SELECT data_id, unnest(['completeness', 'error']) AS check_type, 0.0::DOUBLE AS check_value, 'failed' AS status
FROM processed_data WHERE {T} IS NULL""")
def _(t):
    return Q.quality_checks(docs(t).where(F.col(T).isNull()), keep=("data_id",))


@query("quality_rules", f"""WITH {TEXTS}, docs AS (
 SELECT p.data_id, p.file_id, p.{T}, p.content_type, f.file_type, f.file_size, coalesce(t.n, 0) AS n, coalesce(t.c, 0) AS c
 FROM processed_data p JOIN files f ON f.file_id = p.file_id LEFT JOIN texts t ON t.data_id = p.data_id)
SELECT data_id, file_id, 'min_word_count' AS rule FROM docs WHERE n < 10
UNION ALL SELECT data_id, file_id, 'max_file_size' FROM docs WHERE file_size > 1 * 1024 * 1024
UNION ALL SELECT data_id, file_id, 'require_text_content' FROM docs WHERE n = 0
UNION ALL SELECT data_id, file_id, 'completeness' FROM docs WHERE n < 50
UNION ALL SELECT data_id, file_id, 'validity' FROM docs WHERE {CHECKS['validity'][1]} <> 'good' AND {T} IS NOT NULL
UNION ALL SELECT data_id, file_id, 'consistency' FROM docs WHERE NOT ({SAME})""")
def _(t):
    return Q.quality_rules(docs(t), max_size_mb=1)


@query("quality_of_unanalyzed", f"""WITH {DOCS}, due AS (SELECT d.* FROM docs d JOIN files f ON f.file_id = d.file_id
 WHERE f.processed AND NOT EXISTS (SELECT 1 FROM analytics_results a WHERE a.data_id = d.data_id))
SELECT check_type, status, count(*) AS count FROM ({checked('due')}) GROUP BY check_type, status""")
def _(t):
    due = etl.extract_unanalyzed(t.files, t.processed_data, t.analytics_results)
    return R.quality_overview(Q.quality_checks(due.where(F.col(T).isNotNull())))


# ------------------------------------------------------------------------------------- ETL


def due(t: Tables):
    return etl.extract_unanalyzed(t.files, t.processed_data, t.analytics_results)


DUE = f"""{DOCS}, due AS (SELECT d.* FROM docs d JOIN files f ON f.file_id = d.file_id
 WHERE f.processed AND NOT EXISTS (SELECT 1 FROM analytics_results a WHERE a.data_id = d.data_id))"""


@query("etl_transform", f"""WITH {DUE} SELECT data_id, file_id, {WORD_COUNT} AS word_count, {SENTIMENT} AS sentiment_score,
 {READABILITY} AS readability_score, {HAS_NUMBERS} AS has_numbers, {CAPITAL} AS capital_ratio,
 {CHECKS['validity'][1]} AS validity, {UNIQUE} AS uniqueness FROM due""")
def _(t):
    q = F.col("quality")
    return etl.etl_transform(due(t)).select(
        "data_id", "file_id", "analytics.word_count", "analytics.sentiment_score", "analytics.readability_score",
        "features.has_numbers", "features.capital_ratio", q[1]["status"].alias("validity"),
        q[3]["check_value"].alias("uniqueness"),
    )


@query("load_analytics", f"""WITH {DUE} SELECT data_id, 'basic_analytics' AS analysis_type,
 concat('Processed file with ', n, ' words') AS insights, {SENTIMENT} AS confidence_score,
 CAST(n AS DOUBLE) AS json_words, CAST(s AS DOUBLE) AS json_sentences, {NOW} AS created_date FROM due""")
def _(t):
    rows = etl.analytics_rows(etl.etl_transform(due(t)), as_of())
    return rows.select(
        "data_id", "analysis_type", "insights", "confidence_score",
        SC.json_field("results", "word_count").alias("json_words"),
        SC.json_field("results", "sentence_count").alias("json_sentences"), "created_date",
    )


@query("load_quality", f"""WITH {DUE} SELECT file_id, check_type, check_value, CAST(NULL AS DOUBLE) AS threshold, status,
 {NOW} AS check_date FROM ({checked('due')})""")
def _(t):
    return etl.quality_rows(etl.etl_transform(due(t)), as_of()).drop("metric_id")


RUN = f"""WITH {DUE} SELECT check_type, status, count(*) AS count,
 round(avg(check_value), 6) AS avg_value FROM ({checked('due')}) GROUP BY check_type, status"""


def _loaded(store):
    stored = store.read("data_quality_metrics")
    return rounded(stored.groupBy("check_type", "status").agg(
        F.count("*").alias("count"), F.avg("check_value").alias("avg_value")), "avg_value")


# The second run finds nothing to do, so the metrics are those of one run.
@query("etl_run", RUN)
def _(t):
    store = filled_store(t, "files", "processed_data", "analytics_results")
    etl.etl_run(store)
    etl.etl_run(store)
    return _loaded(store)


@query("incremental_etl", RUN)
def _(t):
    from doclake.streaming.incremental import incremental_etl

    store = filled_store(t, "files", "processed_data", "analytics_results")
    for _ in range(2):
        incremental_etl(store, f"{store.root}/checkpoint").awaitTermination()
    return _loaded(store)


# ----------------------------------------------------------------------------- ingestion

# Every document as the bytes of an uploaded file.
FILE_EXT = """CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.mp3' WHEN 2 THEN '.mp4' WHEN 3 THEN '.zip' ELSE '.html' END"""
UPLOADED = f"""uploaded AS (SELECT concat('doc_', CAST(doc_id AS STRING), {FILE_EXT}) AS filename, {FILE_EXT} AS file_type,
 CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'archives' ELSE 'unknown' END AS content_type,
 text, CASE WHEN doc_id % 5 = 0 AND text IS NULL THEN 'error' ELSE 'ok' END AS extract_status FROM documents)"""


def uploaded_files(t: Tables):
    path = F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), F.expr(FILE_EXT))
    content = F.encode("text", "UTF-8")
    return I.ingest_files(t.documents.select(
        path.alias("path"), as_of().alias("modificationTime"), F.length(content).cast("long").alias("length"), content.alias("content")), as_of=as_of())


@query("ingest_files", f"""WITH {UPLOADED} SELECT filename, file_type, CAST(strlen(text) AS BIGINT) AS file_size, 'upload' AS source_type,
 FALSE AS processed, md5(text) AS content_md5 FROM uploaded""")
def _(t):
    return uploaded_files(t).select(
        "filename", "file_type", "file_size", "source_type", "processed", F.md5("content").alias("content_md5"))


@query("extract_content", f"""WITH {UPLOADED} SELECT filename, content_type, extract_status,
 md5(CASE content_type WHEN 'text' THEN text WHEN 'audio' THEN '{X.AUDIO_TEXT}' WHEN 'video' THEN '{X.VIDEO_TEXT}' ELSE '' END) AS text_md5
FROM uploaded""")
def _(t):
    files = uploaded_files(t)
    return I.extract_content(files).join(files.select("file_id", "filename"), "file_id").select(
        "filename", "content_type", "extract_status", F.md5("extracted_text").alias("text_md5"))


@query("csv_text", r"""SELECT doc_id, md5(array_to_string(list_transform(
 regexp_extract_all(text, '("[^"]*(?:""[^"]*)*"|[^,\r\n]*)(,|\r\n?|\n|\z)'), lambda c: concat(
  CASE WHEN regexp_matches(c, '^"[^"]*(""[^"]*)*"(,|\r\n?|\n|)\z')
   THEN replace(regexp_extract(c, '(?s)^"(.*)"(,|\r\n?|\n|)\z', 1), '""', '"') ELSE regexp_replace(c, '(,|\r\n?|\n)\z', '') END,
  CASE WHEN ends_with(c, ',') AND NOT regexp_matches(c, '^"[^"]*,\z') THEN chr(9) WHEN regexp_matches(c, '[\r\n]\z') THEN chr(10) ELSE '' END)), '')) AS text_md5
 FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(I.csv_text(F.col("text"))).alias("text_md5"))


@query("upload_summary", f"WITH {UPLOADED} SELECT extract_status, count(*) AS count FROM uploaded GROUP BY extract_status")
def _(t):
    return R.upload_summary(I.extract_content(uploaded_files(t)))


# Every document as an office file, of one paragraph, cell or line of a shape for each line of its text.
OFFICE_TEXT = "regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')"
OFFICE_PARTS = {
    ".docx": {"word/document.xml": ('<w:document xmlns:w="w"><w:body>', "<w:p><w:r><w:t>", "</w:t></w:r></w:p>", "</w:body></w:document>")},
    ".pptx": {
        "ppt/presentation.xml": ('<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="s"/></p:sldIdLst></p:presentation>',),
        "ppt/_rels/presentation.xml.rels": ('<Relationships xmlns="l"><Relationship Id="s" Target="slides/slide1.xml"/></Relationships>',),
        "ppt/slides/slide1.xml": ('<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:txBody>', "<a:p><a:r><a:t>", "</a:t></a:r></a:p>",
                                  "</p:txBody></p:sp></p:spTree></p:cSld></p:sld>")},
    ".xlsx": {
        "xl/workbook.xml": ('<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="s"/></sheets></workbook>',),
        "xl/_rels/workbook.xml.rels": ('<Relationships xmlns="l"><Relationship Id="s" Target="worksheets/sheet1.xml"/></Relationships>',),
        "xl/worksheets/sheet1.xml": ('<worksheet xmlns="m"><sheetData>', '<row><c t="inlineStr"><is><t>', "</t></is></c></row>", "</sheetData></worksheet>")},
}


@F.pandas_udf(BinaryType())
def office_file(extension: pd.Series, text: pd.Series) -> pd.Series:
    def package(kind: str, lines: list[str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, (head, *rest) in OFFICE_PARTS[kind].items():
                body = "".join(f"{rest[0]}{escape(line)}{rest[1]}" for line in lines) + rest[2] if rest else ""
                z.writestr(name, head + body)
        return out.getvalue()

    return pd.Series([package(e, t.split("\n")) for e, t in zip(extension, text)])


@query("extract_office", f"""WITH kinds AS (SELECT doc_id, {OFFICE_TEXT} AS text,
 CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.pptx' ELSE '.xlsx' END AS file_type FROM documents)
SELECT doc_id, file_type, 'ok' AS extract_status, md5(CASE file_type WHEN '.xlsx' THEN text ELSE concat(text, chr(10)) END) AS text_md5 FROM kinds""")
def _(t):
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.pptx' ELSE '.xlsx' END")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_id"), kind.alias("file_type"), office_file(kind, text).alias("content"))
    return I.extract_content(files).join(files.select("file_id", "file_type"), "file_id").select(
        F.col("file_id").cast("long").alias("doc_id"), "file_type", "extract_status", F.md5("extracted_text").alias("text_md5"))


# All texts as large files, as many as the texts fill, one document after the other, read again in parts of a megabyte: as
# lines, and as quoted cells in which lines end too.
QUOTED = "concat('\"', replace(coalesce(text, ''), '\"', '\"\"'), '\"')"


@query("text_file_parts", f"""SELECT 'text' AS kind, sum(length(coalesce(text, '')) + 1) AS n_chars,
 sum(len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+'))) AS n_words, 0 AS n_open FROM documents
UNION ALL SELECT 'csv', sum(length({QUOTED}) + 1), sum(len(regexp_extract_all({QUOTED}, '[^{WS}]+'))), 0 FROM documents""")
def _(t):
    folder, text = f"{shared_folder(t.spark)}/doclake/texts-{uuid.uuid4().hex}", F.coalesce("text", F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    frames = []
    for kind, line in (("text", text), ("csv", quoted)):
        t.documents.select(line.alias("line")).hint("rebalance").write.text(f"{folder}/{kind}")
        paths = [unquote(f) for f in t.spark.read.text(f"{folder}/{kind}").inputFiles()]
        parts = read_parts(t.spark, paths, F.lit(kind == "csv"), 1 << 20)
        is_open = F.regexp_count("extracted_text", F.lit('"')) % 2 if kind == "csv" else F.lit(0)
        frames.append(parts.agg(
            F.lit(kind).alias("kind"), F.sum(F.length("extracted_text")).alias("n_chars"),
            F.sum(TX.word_count("extracted_text")).alias("n_words"), F.sum(is_open).cast("int").alias("n_open")))
    return frames[0].unionAll(frames[1])


# --------------------------------------------------------------------------------- scalars

EXTENSION = """CASE WHEN contains(ltrim(list_last(string_split({f}, '/')), '.'), '.')
 THEN lower(concat('.', list_last(string_split({f}, '.')))) ELSE '' END"""


@query("file_extension", f"""SELECT url, {EXTENSION.format(f='url')} AS extension FROM pages
UNION ALL SELECT filename, {EXTENSION.format(f='filename')} FROM files""")
def _(t):
    names = t.pages.select("url").unionAll(t.files.select("filename"))
    return names.select("url", SC.file_extension("url").alias("extension"))


CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN list_contains({sql_list(exts)}, file_type) THEN '{cat}'" for cat, exts in X.FILE_CATEGORIES.items()
) + " ELSE 'unknown' END"


@query("file_category", f"SELECT file_id, {CATEGORY_SQL} AS category FROM files")
def _(t):
    return t.files.select("file_id", SC.file_category("file_type").alias("category"))


@query("is_supported_type", """SELECT file_id, regexp_matches(filename, '[.](txt|csv|pdf)$') AS supported FROM files""")
def _(t):
    return t.files.select("file_id", SC.is_supported_type("filename", [".txt", ".csv", ".pdf"]).alias("supported"))


@query("clean_filename", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(concat(url, '. _'), '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '_. ')
 AS filename FROM pages""")
def _(t):
    return t.pages.select("page_id", SC.clean_filename(F.concat("url", F.lit(". _"))).alias("filename"))


def _size_sql(x: str) -> str:
    cases = " ".join(
        f"WHEN {x} < {1024.0 ** (i + 1)} THEN concat(format('{{{{:.2f}}}}', {x} / {1024.0 ** i}), ' {u}')"
        for i, u in enumerate(X.SIZE_UNITS[:-1])
    )
    return f"CASE WHEN {x} = 0 THEN '0 B' {cases} ELSE concat(format('{{{{:.2f}}}}', {x} / {1024.0 ** 4}), ' TB') END".replace("{{", "{").replace("}}", "}")


@query("format_file_size", f"""SELECT doc_id, {_size_sql('CAST(n_chars AS DOUBLE)')} AS bytes,
 {_size_sql('CAST(n_chars AS DOUBLE) * 1000')} AS thousands, {_size_sql('CAST(n_chars AS DOUBLE) * 1000000')} AS millions,
 {_size_sql('CAST(n_chars AS DOUBLE) * 1000000000000')} AS huge FROM documents""")
def _(t):
    n = F.col("n_chars").cast("double")
    return t.documents.select(
        "doc_id", SC.format_file_size("n_chars").alias("bytes"),
        SC.format_file_size(n * 1000).alias("thousands"), SC.format_file_size(n * 1000000).alias("millions"),
        SC.format_file_size(n * 1000000000000).alias("huge"),
    )


@query("validate_email", f"""SELECT doc_id, regexp_matches(concat(source, lang, '@', left(text, 3), '.', lang), '{X.EMAIL_PATTERN}')
 AS valid FROM documents""")
def _(t):
    email = F.concat("source", "lang", F.lit("@"), F.substring("text", 1, 3), F.lit("."), "lang")
    return t.documents.select("doc_id", SC.validate_email(email).alias("valid"))


@query("md5_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", SC.md5_hash(F.encode("text", "UTF-8")).alias("hash"))


@query("unique_id", "SELECT count(*) AS rows, count(*) AS ids, count(*) AS prefixed FROM documents")
def _(t):
    ids = t.documents.select(SC.unique_id("doc").alias("id"))
    return ids.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").startswith("doc_")).alias("prefixed"))


@query("to_json_safe", """SELECT event_id, to_json({'event_id': event_id,  'ts': CASE WHEN microsecond(ts) % 1000000 = 0
 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END, 'event_type': nullif(event_type, 'error'), 'props': props}) AS json FROM events""")
def _(t):
    rows = t.events.withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return rows.select("event_id", SC.to_json_safe(rows, ["event_id", "ts", "event_type", "props"]).alias("json"))


BROKEN = "CASE WHEN event_type = 'error' THEN left(props, 4) ELSE props END"


@query("parse_json_safe", f"""SELECT event_id, json_valid({BROKEN}) AS valid,
 CASE WHEN json_valid({BROKEN}) THEN CAST(json_extract_string({BROKEN}, '$.k') AS INT) END AS k FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = t.events.select("event_id", SC.parse_json_safe(text).alias("v"))
    return parsed.select("event_id", F.col("v").isNotNull().alias("valid"), F.try_variant_get("v", "$.k", "int").alias("k"))


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(t):
    return t.events.select("event_id", SC.json_field("props", "k").alias("k"))


@query("to_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t):
    return t.events.select("event_id", SC.to_day("ts").alias("day"))


# One text per event, in a shape that depends on its type.
STAMP_SQL = """CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
 WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+02:30' WHEN 'error' THEN strftime(ts, '%Y-%m-%d')
 WHEN 'signup' THEN strftime(ts, '%d.%m.%Y %H:%M') ELSE strftime(ts, '%Y-%m-%dx%H:%M') END"""


@query("parse_timestamp", """SELECT event_id, CASE event_type WHEN 'view' THEN date_trunc('second', ts)
 WHEN 'click' THEN ts - INTERVAL '150' MINUTE WHEN 'error' THEN date_trunc('day', ts)
 WHEN 'signup' THEN NULL ELSE date_trunc('minute', ts) END AS parsed FROM events""")
def _(t):
    def shape(pattern):
        return F.date_format("ts", pattern)

    kind = F.col("event_type")
    text = (
        F.when(kind == "view", shape("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.concat(shape("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:30")))
        .when(kind == "error", shape("yyyy-MM-dd"))
        .when(kind == "signup", shape("dd.MM.yyyy HH:mm"))
        .otherwise(shape("yyyy-MM-dd'x'HH:mm"))
    )
    return t.events.select("event_id", SC.parse_timestamp(text).alias("parsed"))


@query("time_ago", f"""
WITH moments AS (SELECT event_id AS id, ts FROM events UNION ALL SELECT -o_orderkey, o_orderdate FROM orders),
spans AS (SELECT id, floor(date_diff('microsecond', ts, {NOW}) / 1000000) AS s FROM moments),
units AS (SELECT id, s, CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 30 * 86400 THEN 'day'
  WHEN s < 365 * 86400 THEN 'month' ELSE 'year' END AS u FROM spans)
SELECT id, CASE WHEN s < 60 THEN 'just now' ELSE concat(k, ' ', u, CASE WHEN k = 1 THEN '' ELSE 's' END, ' ago') END AS ago
FROM (SELECT *, CAST(floor(s / CASE u WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400
 WHEN 'month' THEN 30 * 86400 ELSE 365 * 86400 END) AS BIGINT) AS k FROM units)""")
def _(t):
    moments = t.events.select(F.col("event_id").alias("id"), "ts").unionAll(
        t.orders.select(-F.col("o_orderkey"), "o_orderdate")
    )
    return moments.select("id", SC.time_ago("ts", as_of()).alias("ago"))


@query("completion_rate_fmt", """
SELECT file_type, concat(format('{:.1f}', count(*) FILTER (WHERE processed) / count(*) * 100), '%') AS rate
FROM files GROUP BY file_type""")
def _(t):
    per_type = t.files.groupBy("file_type").agg((F.count_if("processed") / F.count("*") * 100).alias("r"))
    return per_type.select("file_type", SC.percent_text("r").alias("rate"))


@query("timestamp_string", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(t):
    return t.events.select("event_id", SC.timestamp_string("ts").alias("stamp"))


@query("url_host", "SELECT page_id, string_split(string_split(url, '//')[2], '/')[1] AS host FROM pages")
def _(t):
    return t.pages.select("page_id", U.url_host("url").alias("host"))


FILE_URL = "regexp_matches(lower(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[.](pdf|doc|docx|jpg|png|gif|zip)$')"


@query("is_file_url", f"""SELECT page_id, {FILE_URL.format(u="concat(url, '.PDF')")} AS is_file,
 {FILE_URL.format(u='url')} AS is_page_file FROM pages""")
def _(t):
    return t.pages.select(
        "page_id", U.is_file_url(F.concat("url", F.lit(".PDF"))).alias("is_file"), U.is_file_url("url").alias("is_page_file")
    )


@query("is_valid_url", f"""SELECT page_id, list_contains(
 ['ththre.example.com', 'm.ththth.example.net', 'thther.example.org'], string_split(string_split(url, '//')[2], '/')[1])
 AND NOT {FILE_URL.format(u='url')} AS valid FROM pages""")
def _(t):
    hosts = ["ththre.example.com", "m.ththth.example.net", "thther.example.org"]
    return t.pages.select("page_id", U.is_valid_url("url", hosts).alias("valid"))
