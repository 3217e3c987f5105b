import datetime as dt
import json
import os

from pyspark.sql import functions as F

from doclake.functions import scalars as SC, urls as U


def column(spark, values, kind, expression):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_file_extension(spark):
    names = ["a.TXT", ".bashrc", "x.tar.gz", "noext", "dir.d/file", "a.", "..b", "...c.txt", "d/.x", "d/.x.y", "", "a b.C"]
    assert column(spark, names, "string", SC.file_extension) == [os.path.splitext(n)[1].lower() for n in names]


def test_category_and_support(spark):
    exts = [".txt", ".csv", ".tiff", ".7z", ".sys", ".html", "", None]
    got = column(spark, exts, "string", SC.file_category)
    assert got == ["text", "spreadsheets", "images", "archives", "executables", "unknown", "unknown", "unknown"]
    assert column(spark, ["a.PDF", "b.doc"], "string", lambda c: SC.is_supported_type(c, [".pdf"])) == [True, False]


def test_clean_filename(spark):
    names = ['a<b>:c"/\\|?*.txt', "__x__", " . a_b . ", "___", "plain"]
    want = ["a_b_c_.txt", "x", "a_b", "", "plain"]
    assert column(spark, names, "string", SC.clean_filename) == want


def test_format_file_size(spark):
    sizes = [0, 1, 1023, 1024, 1152, 1280, 1_048_576, 5 * 2**40, 3 * 2**50, 1_047_552, 123_456_789]

    def plain(n):
        if n == 0:
            return "0 B"
        power = min(4, max(p for p in range(5) if n >= 1024**p))
        return f"{n / 1024**power:.2f} {['B', 'KB', 'MB', 'GB', 'TB'][power]}"

    assert column(spark, sizes, "long", SC.format_file_size) == [plain(n) for n in sizes]


def test_email(spark):
    mails = ["a@b.co", "a.b+c@d-e.org", "a@b", "@b.co", "a b@c.de", "a@b.c", "x@y.zz9"]
    assert column(spark, mails, "string", SC.validate_email) == [True, True, False, False, False, False, False]


def test_ids_and_hash(spark):
    assert column(spark, [b"abc"], "binary", SC.md5_hash) == ["900150983cd24fb0d6963f7d28e17f72"]
    first, again = (column(spark, ["k"], "string", lambda c: SC.stable_id(c, prefix="p")) for _ in range(2))
    assert first == again and first[0].startswith("p_")
    assert len(set(column(spark, ["k", "k"], "string", lambda c: SC.unique_id("u")))) == 2


def test_json(spark):
    texts = ['{"a": 1}', "[1]", "{'a': 1}", "nope", "", None]
    assert [v is not None for v in column(spark, texts, "string", lambda c: SC.parse_json_safe(c).cast("string"))] == [
        True, True, False, False, False, False]
    assert column(spark, ['{"a": 1.5}', '{"a": "x"}', "bad"], "string", lambda c: SC.json_field(c, "a")) == [1.5, None, None]
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 2, 3, 4, 5), bytearray(b"ok\xff!"), "é", None)],
        "n int, t timestamp, b binary, s string, z string")
    got = df.select(SC.to_json_safe(df)).first()[0]
    assert json.loads(got) == {"n": 1, "t": "2024-01-02T03:04:05", "b": "ok!", "s": "é", "z": None}
    assert "é" in got


def test_parse_timestamp(spark):
    texts = ["2024-01-02", "2024-01-02T03:04", "2024-01-02 03:04:05", "2024-01-02T03:04:05.678", "2024-01-02T03:04:05Z",
             "2024-01-02T03:04:05.678901+02:30", "2024-01-02T25:00", "2024-13-02", "2024-1-2", "x", "", "2024-01-02T03:04:05.6"]
    got = column(spark, texts, "string", lambda c: F.date_format(SC.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert got[:6] == ["2024-01-02 00:00:00.000000", "2024-01-02 03:04:00.000000", "2024-01-02 03:04:05.000000",
                       "2024-01-02 03:04:05.678000", "2024-01-02 03:04:05.000000", "2024-01-02 00:34:05.678901"]
    assert got[6:] == [None] * 6


def test_time_ago(spark):
    now = dt.datetime(2024, 6, 1, 12)
    spans = {-5: "just now", 59: "just now", 60: "1 minute ago", 3599: "59 minutes ago", 3600: "1 hour ago",
             86399: "23 hours ago", 86400: "1 day ago", 29 * 86400: "29 days ago", 30 * 86400: "1 month ago",
             364 * 86400: "12 months ago", 365 * 86400: "1 year ago", 800 * 86400: "2 years ago"}
    got = column(spark, [now - dt.timedelta(seconds=s) for s in spans], "timestamp", lambda c: SC.time_ago(c, F.lit(now)))
    assert got == list(spans.values())


def test_formats(spark):
    assert column(spark, [12.25, 12.35, 0.0, 100.0], "double", SC.percent_text) == [f"{v:.1f}%" for v in (12.25, 12.35, 0.0, 100.0)]
    assert column(spark, [dt.datetime(2024, 1, 2, 3, 4, 5)], "timestamp", SC.timestamp_string) == ["20240102_030405"]
    assert column(spark, [dt.datetime(2024, 1, 2, 3, 4, 5)], "timestamp", SC.to_day) == [dt.date(2024, 1, 2)]


def test_urls(spark):
    urls = ["http://h.org/a", "https://u@h.org:80/x?y#z", "mailto:a@b", "/rel", "HTTP://H/a.PDF;v=1", "http://h/a.pdf?x", "ftp://h/a"]
    assert column(spark, urls, "string", U.url_host) == ["h.org", "u@h.org:80", "", "", "H", "h", "h"]
    assert column(spark, urls, "string", U.is_file_url) == [False, False, False, False, True, True, False]
    assert column(spark, urls, "string", lambda c: U.is_valid_url(c, ["h.org", "h", "H"])) == [True, False, False, False, False, False, False]
    assert column(spark, ["http://h/a#b", "http://h/a"], "string", U.without_fragment) == ["http://h/a"] * 2
