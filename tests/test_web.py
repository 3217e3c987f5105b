import os
import re
from collections import deque
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from doclake.operators import web as W
from doclake.session import scratch

# html -> (title, content)
GOLDENS = [
    ("<title>T</title><body><p>a<p>b</body>", "T", "ab"),
    ("<html><head><title>A &amp; B</title></head><body>x<article> one <b>two</b>\n\n  three </article>y</body>", "A & B", "one two three"),
    ("<body>out<article>first</article><article>second</article></body>", "", "first"),
    ("no tags at all", "", "no tags at all"),
    ("<div>a</div><div>b</div>", "", "ab"),
    ("<body>a<script>var x='</p>';</script><style>p{}</style>b</body>", "", "ab"),
    ("<!DOCTYPE html><!-- c --><body>a<!-- no -->b</body>", "", "ab"),
    ("<title>a<b>c</b></title>x", None, "acx"),
    ("<title></title>x", None, "x"),
    ("<title><b>only</b></title>", "only", "only"),
    ("<body><article><p>open<div>x</article>after</body>", "", "openx"),
    ("<body>a</p>b</nope>c<br>d<br/>e</body>", "", "abcde"),
    ("<body>&lt;tag&gt; &#233;&#x41; &copy; &unknown; R&D</body>", "", "<tag> éA © &unknown R&D"),
    ("<body>a<template>t</template><ruby>b<rt>r</rt></ruby></body>", "", "ab"),
    ("<body><p>a</p> \n <p>b</p>\t\t<p>c  d</p></body>", "", "a b c d"),
    ("<title>one</title><body>x</body><title>two</title>", "one", "x"),
    ("", "", ""),
    ("<article>never closed", "", "never closed"),
    ("<body>a</body>tail", "", "a"),
    ("<p>a<![CDATA[raw]]>b", "", "arawb"),
]


def pages_of(spark, pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def parsed(spark):
    pages = pages_of(spark, [(f"http://h/{i}", g[0]) for i, g in enumerate(GOLDENS)])
    return W.parse_pages(pages).orderBy("page_id").collect()


@pytest.mark.parametrize("i", range(len(GOLDENS)))
def test_parse(parsed, i):
    html, title, content = GOLDENS[i]
    row = parsed[i]
    assert (row["title"], row["content"], row["parse_status"]) == (title, content, "ok")
    assert row["word_count"] == len(content.split()) and row["char_count"] == len(content)


def test_pages_are_parsed_once(spark, capsys):
    pages = pages_of(spark, [("http://h/1", "x"), ("http://h/2", None)])
    known = spark.createDataFrame([("http://h/1",), ("http://h/2",)], "url string")
    good = W.parse_pages(pages.join(known, "url", "left_semi")).where("parse_status = 'ok'").select("page_id", "title")
    good.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert [r["page_id"] for r in good.collect()] == [0]


def test_bad_pages_keep_their_row(spark):
    rows = W.parse_pages(pages_of(spark, [("http://h/", None), (None, "x")])).collect()
    assert [r["parse_status"] for r in rows] == ["error", "error"]


LINKS = ('<a href="/a">1</a><a href="b?q#f">2</a><a href="/a">again</a><a name="x">no</a><a href>self</a>'
         '<a href="mailto:x@y.z">m</a><a href="http://other/">o</a><a href="x.PDF">f</a><a href="//h/c">c</a>'
         '<script>"<a href=/no>"</script>')


def test_links(spark):
    parsed = W.parse_pages(pages_of(spark, [("http://h/d/e", LINKS), ("http://h/f", LINKS + '<a href="http://[x">bad</a>')]))
    counts = {r["url"]: (r["internal_links"], r["external_links"]) for r in W.link_counts(parsed).collect()}
    assert counts == {"http://h/d/e": (6, 2), "http://h/f": (6, 3)}
    edges = sorted((r["pos"], r["dst"]) for r in W.page_links(parsed).where("src = 'http://h/d/e'").collect())
    assert edges == [(0, "http://h/a"), (1, "http://h/d/b?q#f"), (2, "http://h/d/e"), (3, "http://h/c")]
    assert W.page_links(parsed).where("src = 'http://h/f'").count() == 0  # an unresolvable link voids the page's list
    assert W.page_links(parsed, ["other"]).select("dst").distinct().collect()[0][0] == "http://other/"


def a(*targets):
    return "<title>t</title>" + "".join(f'<a href="{t}">x y</a> ' for t in targets)


GRAPH = {
    "http://h/": a("/1", "/2", "/1", "http://g/", "mailto:a@b", "/doc.pdf", "/missing"),
    "http://h/1": a("/3", "/4", "/", "/2#top"),
    "http://h/2": a("/5", "/1", "/3"),
    "http://h/3": a("/6"),
    "http://h/4": a("/6", "/7"),
    "http://h/5": "plain",
    "http://h/6": a("/8", "/"),
    "http://h/7": a("/1"),
    "http://h/8": a(),
    "http://g/": a("/1", "http://h/5"),
    "http://g/1": a("http://h/"),
}


def queue_crawl(base, max_pages, allowed=None, seen=()):
    """First-in first-out crawl over GRAPH, one page at a time."""
    hosts = set(allowed or [urlparse(base).netloc])

    def followed(url):
        targets = (urljoin(url, h) for h in re.findall('href="([^"]*)"', GRAPH[url.split("#")[0]]))
        return [t for t in targets if t.startswith("http") and urlparse(t).netloc in hosts and not t.endswith(".pdf")]

    waiting, found = deque([base]), {}
    while waiting:
        url = waiting.popleft()
        if len(found) < max_pages and url not in found and url not in seen and url.split("#")[0] in GRAPH:
            found[url] = True
            waiting += followed(url)
    return list(found)


@pytest.fixture(scope="module")
def site(spark):
    return pages_of(spark, list(GRAPH.items())).cache()


@pytest.mark.parametrize("base, cap, allowed", [
    ("http://h/", 50, None), ("http://h/", 4, None), ("http://h/", 1, None), ("http://h/", 7, ["h", "g"]),
    ("http://h/", 50, ["g"]), ("http://nowhere/", 50, None)])
def test_crawl_order(site, base, cap, allowed):
    rows = W.crawl_website(site, base, cap, allowed).orderBy("crawl_rank").collect()
    assert [r["url"] for r in rows] == queue_crawl(base, cap, allowed)
    assert [r["crawl_rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_crawl_depth_external_and_visited(spark, site):
    assert [r["url"] for r in W.crawl_website(site, "http://h/", max_depth=1).orderBy("crawl_rank").collect()] == [
        "http://h/", "http://h/1", "http://h/2"]
    everywhere = {r["url"].split("#")[0] for r in W.crawl_website(site, "http://g/1", follow_external=True).collect()}
    assert everywhere == set(GRAPH)
    seen = ["http://h/1", "http://h/4"]
    visited = spark.createDataFrame([(u,) for u in seen], "url string")
    got = [r["url"] for r in W.crawl_website(site, "http://h/", visited=visited).orderBy("crawl_rank").collect()]
    assert got == queue_crawl("http://h/", 50, seen=seen)


def test_many_sources(spark, site):
    sources = spark.createDataFrame(
        [("h", "http://h/", 3, None), ("g", "http://g/", None, ["g", "h"]), ("none", "http://x/", 5, None), ("bad", None, 5, None)],
        "source_name string, base_url string, max_pages long, allowed_domains array<string>")
    crawled = W.crawl_many(sources, site).cache()
    for name, want in (("h", queue_crawl("http://h/", 3)), ("g", queue_crawl("http://g/", 50, ["g", "h"]))):
        rows = crawled.where(F.col("source_name") == name).orderBy("crawl_rank").collect()
        assert [r["url"] for r in rows] == want
    summary = {r["source_name"]: (r["success"], r["pages_crawled"], r["error"]) for r in W.crawl_source_summary(sources, crawled).collect()}
    assert summary["h"] == (True, 3, None) and summary["none"] == (True, 0, None) and summary["bad"] == (False, 0, "'base_url'")
    default = W.crawl_many(sources.drop("max_pages"), site)  # 50 pages of each source
    assert [r["url"] for r in default.where("source_name = 'h'").orderBy("crawl_rank").collect()] == queue_crawl("http://h/", 50)
    total = W.crawl_summary(crawled).first()
    assert total["pages_crawled"] == crawled.count() and total["total_words"] > 0
    shown = W.crawl_results(crawled.limit(1)).first()
    assert shown["title"] == "t" and set(shown.asDict()) == {"title", "url", "word_count", "links"}


def test_a_source_without_a_limit_is_crawled_to_its_end(spark):
    chain = spark.range(70).select(F.col("id").alias("page_id"), F.format_string("http://w/%d", F.col("id")).alias("url"), F.when(
        F.col("id") == 0, "".join(f'<a href="/{i}">x</a>' for i in range(70))).otherwise("end").alias("html"))
    sources = spark.createDataFrame([("w", "http://w/0", None, None)], "source_name string, base_url string, max_pages int, allowed_domains array<string>")
    assert W.crawl_many(sources, chain).count() == 70 and W.crawl_many(sources.drop("max_pages"), chain).count() == 50
    assert W.crawl_website(chain, "http://w/0", max_pages=None).count() == 70


def test_store_pages(spark, site):
    files, processed = W.store_pages(W.parse_pages(site, keep=("page_id", "html")))
    assert files.count() == processed.count() == len(GRAPH)
    row = files.join(processed, "file_id").where("filename like 'webpage_%' and extracted_text = 'plain'").first()
    assert row["source_type"] == "web_crawl" and row["content_type"] == "web_page" and bytes(row["content"]) == b"plain"


def test_deep_crawl(spark):
    """A chain longer than the number of levels that are kept apart."""
    n = 20
    chain = pages_of(spark, [(f"http://c/{i}", a(f"/{i + 1}", f"/{i - 1}")) for i in range(n)])
    rows = W.crawl_website(chain, "http://c/0", max_pages=19).orderBy("crawl_rank").collect()
    assert [(r["url"], r["depth"], r["crawl_rank"]) for r in rows] == [(f"http://c/{i}", i, i + 1) for i in range(n - 1)]


def test_walk_reads_links_only_and_cleans_up(spark, site, monkeypatch):
    """No written table of the walk holds a text, none is ranked by a window, and none is left behind."""
    made = []

    def spy(df, label):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString(), label
        made.append((label, set(df.columns), W_written(df, label)))
        return made[-1][2]

    W_written = W.written
    monkeypatch.setattr(W, "written", spy)
    with scratch():
        for cap in (3, 1_000_000):
            assert W.crawl_website(site, "http://h/", cap).count() == len(queue_crawl("http://h/", cap))
        folders = [f.rsplit("/", 1)[0].removeprefix("file://") for _, _, df in made for f in df.inputFiles()]
        assert folders and all(map(os.path.isdir, folders))
    assert not any(columns & {"content", "html"} for _, columns, _ in made)
    assert not any(map(os.path.exists, folders))
