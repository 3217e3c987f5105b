"""Stored web pages: parsing, links, breadth-first crawl over the page table."""

from __future__ import annotations

import html as html_std
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from doclake.functions import scalars as SC, text as TX, urls as U
from doclake.session import written

# --- fixed values: tags of the HTML standard with a special role ----------------
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source",
    "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
}
REMOVED_TAGS = {"script", "style"}
UNPRINTED_TAGS = {"template", "rt", "rp"}
VERBATIM_TAGS = {"pre", "textarea"}

NO_LIMIT, DEFAULT_PAGES = 1 << 62, 50  # pages of a source
LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("internal", T.BooleanType())])
PARSED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("raw_text", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)), T.StructField("error", T.StringType()),
])


class _Page(HTMLParser):
    """Collects title, printable text and link targets of one page in one pass.

    ``parts`` holds the printable strings in order; the first article and the first body
    are remembered as ranges of it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.parts: list[str] = []
        self.span: dict[str, list] = {}
        self.hrefs: list[str] = []
        self.data: list[str] = []
        self.title = None           # nested lists: the children of the first title
        self.title_path: list = []

    def _inside(self, tags: set[str]) -> bool:
        return any(t in tags for t in self.open)

    def _flush(self, kind: str = "text") -> None:
        if not self.data:
            return
        text, self.data = "".join(self.data), []
        if not text.strip(" \n\t\x0c\r") and kind == "text" and not self._inside(VERBATIM_TAGS):
            text = "\n" if "\n" in text else " "
        if self._inside(REMOVED_TAGS):
            return
        if self.title_path:
            self.title_path[-1].append(text)
        if kind == "text" and not self._inside(UNPRINTED_TAGS):
            self.parts.append(text)

    def _start(self, tag: str, attrs, closed: bool) -> None:
        self._flush()
        if tag == "a" and not self._inside(REMOVED_TAGS):
            target = dict(attrs)
            if "href" in target:
                self.hrefs.append(target["href"] or "")
        if self.title_path or (tag == "title" and self.title is None):
            children: list = []
            if self.title_path and tag not in REMOVED_TAGS:
                self.title_path[-1].append(children)
            elif not self.title_path:
                self.title = children
            self.title_path.append(children)
        self.open.append(tag)
        if tag in ("article", "body") and tag not in self.span:
            self.span[tag] = [len(self.parts), None, len(self.open)]
        if closed or tag in VOID_TAGS:
            self._pop()

    def _pop(self) -> None:
        tag = self.open.pop()
        if self.title_path:
            self.title_path.pop()
        span = self.span.get(tag)
        if span and span[1] is None and len(self.open) < span[2]:
            span[1] = len(self.parts)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, closed=False)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.open:
            while self.open[-1] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self.data.append(data)

    def handle_charref(self, name):
        self.data.append(html_std.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.data.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self._flush()
        self.data.append(data)
        self._flush("comment")

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self.data.append(data[len("CDATA["):])
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()

    def text(self) -> str:
        start, end, _ = self.span.get("article") or self.span.get("body") or (0, None, 0)
        return "".join(self.parts[start:end])

    def title_text(self) -> str | None:
        """'' without a title; None when the title is not made of one string."""
        if self.title is None:
            return ""
        node = self.title
        while isinstance(node, list):
            if len(node) != 1:
                return None
            node = node[0]
        return node


def _link(base: str, host: str, href: str) -> dict:
    try:
        url = urljoin(base, href)
        return {"url": url, "internal": urlparse(url).netloc == host}
    except ValueError:
        return {"url": None, "internal": False}


def _parse_one(html: str | None, url: str | None) -> tuple:
    if html is None or url is None:
        return None, None, None, "no page"
    try:
        page = _Page()
        page.feed(html)
        page.close()
        host = urlparse(url).netloc
        return page.title_text(), page.text(), [_link(url, host, h) for h in page.hrefs], None
    except Exception as e:  # one bad page is a row with a status, not a failed job
        return None, None, None, f"{type(e).__name__}: {e}"


@F.pandas_udf(PARSED)
def _parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [_parse_one(h, u) for h, u in zip(html, url)]
    return pd.DataFrame(rows, columns=["title", "raw_text", "links", "error"])


# So named, filters on its result are not moved below a join, where they would parse every page a second time.
_parse = _parse.asNondeterministic()


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), as_of: Column | None = None) -> DataFrame:
    """Title, clean text, counts and resolved links of every page.

    Text comes from the first article, else the body, else the whole page. A page that
    cannot be parsed keeps its row with ``parse_status = 'error'``.
    """
    parsed = pages.select(*keep, "url", _parse("html", "url").alias("p")).select(
        *keep, "url", "p.title", TX.clean_text("p.raw_text").alias("content"), "p.links",
        F.col("p.error").alias("parse_error"),
    )
    internal, links = F.size(F.filter("links", lambda x: x["internal"])), F.size("links")
    return parsed.select(
        *keep, "url", "title", "content",
        F.lit("web_page").alias("content_type"),
        TX.word_count("content").alias("word_count"),
        TX.char_count("content").alias("char_count"),
        internal.alias("internal_links"),
        (links - internal).alias("external_links"),
        (F.current_timestamp() if as_of is None else as_of).alias("crawled_at"),
        "links",
        F.when(F.col("parse_error").isNull(), "ok").otherwise("error").alias("parse_status"),
        "parse_error",
    )


def _page_targets(links: Column) -> Column:
    """URLs of other pages in document order, each once.

    If one target cannot be resolved, the page gives no links at all.
    """
    urls = F.transform(F.filter(links, lambda x: U.is_page_url(x["url"])), lambda x: x["url"])
    broken = F.exists(links, lambda x: x["url"].isNull())
    return F.when(~broken, F.array_distinct(urls)).otherwise(F.array().cast("array<string>"))


def page_links(parsed: DataFrame, allowed_domains: list[str] | None = None) -> DataFrame:
    """Edges src -> dst with the position of the link among the page's valid links.

    Without ``allowed_domains`` a page may link to its own host only. Duplicates are
    dropped inside the page's own array, so nothing is shuffled.
    """
    allowed = F.array(U.url_host("url")) if allowed_domains is None else F.array(*[F.lit(d) for d in allowed_domains])
    targets = parsed.select("url", _page_targets(F.col("links")).alias("t"), allowed.alias("a"))
    kept = targets.select("url", F.filter("t", lambda x: F.array_contains(F.col("a"), U.url_host(x))).alias("t"))
    return kept.select(F.col("url").alias("src"), F.posexplode_outer("t").alias("pos", "dst")).where("dst IS NOT NULL")


def link_counts(parsed: DataFrame) -> DataFrame:
    return parsed.select("url", "internal_links", "external_links")


# ------------------------------------------------------------------------------- crawl


def crawl_many(sources: DataFrame, pages: DataFrame, max_depth: int | None = None,
               follow_external: bool = False, visited: DataFrame | None = None) -> DataFrame:
    """Breadth-first crawl of a page table from several sources, all advancing together.

    ``sources``: source_name, base_url, max_pages (NULL: no limit; without the column 50 each), allowed_domains (NULL:
    the base's host).
    ``visited``: optional source_name, url of an earlier crawl, not to be fetched again.

    One round of jobs per level. A level in queue order is the links of the level before,
    ordered by (rank of the linking page, position of the link), so ranking each level
    gives the order of a first-in first-out queue. A level is sorted into ranges of
    (source, parent rank, position); a row's rank is its place in its range plus the rows of
    its source in earlier ranges, so no source is one task's work, whatever ``max_pages`` is.

    The walk reads links only. The texts of the pages it found are parsed at its end.
    """
    spark = pages.sparkSession
    base_host = U.url_host("base_url")
    limit = F.coalesce(F.col("max_pages").cast("long"), F.lit(NO_LIMIT)) if "max_pages" in sources.columns else F.lit(DEFAULT_PAGES).cast("long")
    config = sources.where(F.col("base_url").isNotNull()).select(
        "source_name", "base_url", limit.alias("max_pages"),
        F.coalesce("allowed_domains", F.array(base_host)).alias("allowed"),
    )

    candidates = pages.select("page_id", "url", "html")
    if not follow_external:
        # Written, so the planner sees how small it is and broadcasts it to the page scan.
        hosts = config.select(F.explode(F.array_union("allowed", F.array(base_host))).alias("_host")).distinct()
        hosts = written(hosts, "hosts")
        candidates = candidates.withColumn("_host", U.url_host("url")).join(hosts, "_host", "left_semi").drop("_host")
    node = F.struct("page_id", "parse_status", _page_targets(F.coalesce("links", F.array())).alias("targets"))
    nodes = written(
        parse_pages(candidates).select(U.without_fragment("url").alias("fetch_url"), "page_id", node.alias("n"))
        .where(F.col("n.parse_status") == "ok")  # a broken copy must not hide a good one
        .groupBy("fetch_url").agg(F.min_by("n", "page_id").alias("n"))
        .select("fetch_url", "n.page_id", "n.targets"),
        "links",
    )

    frontier = config.select(
        "source_name", "max_pages", "allowed", F.lit(0).cast("long").alias("done"),
        F.col("base_url").alias("url"), F.lit(0).cast("long").alias("parent_rank"), F.lit(0).alias("pos"),
    )
    columns = ["source_name", "crawl_rank", "depth", "url", "page_id"]
    found: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth <= max_depth:
        seen = [f.select("source_name", "url") for f in found + ([] if visited is None else [visited])]
        if seen:
            frontier = frontier.join(reduce(DataFrame.unionAll, seen), ["source_name", "url"], "left_anti")
        # Written first, so its size is known when the join is planned: a small frontier is
        # broadcast to the link table, which then is not shuffled at every level.
        frontier = written(frontier.withColumn("fetch_url", U.without_fragment("url")), "frontier")
        level = written(
            _ranked(frontier.join(nodes, "fetch_url"))
            .withColumn("crawl_rank", F.col("_n") + F.col("done"))
            .where(F.col("crawl_rank") <= F.col("max_pages"))
            .select("source_name", "max_pages", "allowed", "url", "page_id", "targets", "crawl_rank",
                    (F.col("done") + F.col("_total")).alias("done"), F.lit(depth).alias("depth")),
            "level",
        )
        if level.isEmpty():
            break
        depth += 1
        found.append(level.select(*columns))
        if len(found) == 16:  # a deep crawl does not pile up one scan per level
            found = [written(reduce(DataFrame.unionAll, found), "found")]
        links = level.where(F.col("done") < F.col("max_pages")).select(
            "source_name", "max_pages", "allowed", "done", "crawl_rank", F.posexplode("targets").alias("pos", "url")
        )
        if not follow_external:
            links = links.where(F.array_contains("allowed", U.url_host("url")))
        frontier = links.groupBy("source_name", "url").agg(
            F.min(F.struct(F.col("crawl_rank").alias("parent_rank"), "pos")).alias("first"),
            *[F.any_value(c).alias(c) for c in ("max_pages", "allowed", "done")],
        ).select("source_name", "url", "max_pages", "allowed", "done", "first.*")

    # The pages found are written tables of known size, broadcast to the scan of the pages while small.
    crawled = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame(
        [], "source_name string, crawl_rank long, depth int, url string, page_id long"
    )
    found_pages = candidates.join(crawled.select("page_id"), "page_id", "left_semi")
    details = parse_pages(found_pages).where("parse_status = 'ok'").select(
        "page_id", "title", "content", "content_type", "word_count", "char_count",
        "internal_links", "external_links", "crawled_at",
    )
    return crawled.join(details, "page_id").withColumn("file_id", page_file_id("url"))


def _ranked(level: DataFrame) -> DataFrame:
    """The level with ``_n``, a row's place from 1 in its source's queue, and ``_total``, the source's rows."""
    ordered = written(
        level.repartitionByRange("source_name", "parent_rank", "pos", "url")
        .sortWithinPartitions("source_name", "parent_rank", "pos", "url")
        .withColumn("_place", F.monotonically_increasing_id()),  # range in the high bits, place in it in the low ones
        "ordered",
    )
    in_range = F.shiftright("_place", 33)
    ranges = ordered.groupBy("source_name", in_range.alias("r")).agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    # One short list per source: a row for each range that holds some of it.
    sources = ranges.groupBy("source_name").agg(F.collect_list(F.struct("r", "n", "first")).alias("_ranges"), F.sum("n").alias("_total"))
    before = F.aggregate(
        "_ranges", F.lit(0).cast("long"),
        lambda total, x: total + F.when(x["r"] < in_range, x["n"]).when(x["r"] == in_range, 1 - x["first"]).otherwise(0),
    )
    return ordered.join(sources, "source_name").withColumn("_n", F.col("_place") + before).drop("_place", "_ranges")


def crawl_website(pages: DataFrame, base_url: str, max_pages: int | None = DEFAULT_PAGES, allowed_domains: list[str] | None = None,
                  max_depth: int | None = None, follow_external: bool = False,
                  visited: DataFrame | None = None) -> DataFrame:
    """Crawl one site; the base URL itself need not be on an allowed host."""
    source = pages.sparkSession.createDataFrame(
        [(base_url, base_url, max_pages, allowed_domains)],
        "source_name string, base_url string, max_pages long, allowed_domains array<string>",
    )
    if visited is not None:
        visited = visited.select(F.lit(base_url).alias("source_name"), "url")
    return crawl_many(source, pages, max_depth, follow_external, visited)


def crawl_source_summary(sources: DataFrame, crawled: DataFrame) -> DataFrame:
    """Per source: success, number of pages, error. Sources without a page keep their row."""
    counts = crawled.groupBy("source_name").agg(F.count("*").alias("n"))
    ok = F.col("base_url").isNotNull()
    return sources.select("source_name", "base_url").join(counts, "source_name", "left").select(
        "source_name",
        ok.alias("success"),
        F.coalesce("n", F.lit(0)).alias("pages_crawled"),
        F.when(~ok, "'base_url'").alias("error"),
    )


def crawl_summary(crawled: DataFrame) -> DataFrame:
    return crawled.agg(
        F.count("*").alias("pages_crawled"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.count_distinct("url").alias("unique_urls"),
    )


def crawl_results(crawled: DataFrame) -> DataFrame:
    """The result table: title to 50 characters, URL to 80, words, internal links."""
    return crawled.select(
        TX.cut(F.coalesce("title", F.lit("No title")), 50).alias("title"),
        TX.cut("url", 80).alias("url"),
        "word_count",
        F.col("internal_links").alias("links"),
    )


# ----------------------------------------------------------------------------- storage


def page_file_id(url) -> Column:
    return F.concat(F.lit("web_"), F.sha2(F.col(url) if isinstance(url, str) else url, 256))


def store_pages(parsed: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for ``files`` and ``processed_data`` from parsed pages that kept their ``html``.

    ``parse_pages(pages, keep=("page_id", "html"))`` carries the raw page along, so it need
    not be joined back.
    """
    now = F.current_timestamp() if as_of is None else as_of
    good = parsed.where(F.col("parse_status") == "ok") if "parse_status" in parsed.columns else parsed
    raw = F.encode("html", "UTF-8")
    file_id = page_file_id("url")
    about = F.struct("url", "title", "word_count", "char_count", "internal_links", "external_links")
    files = good.select(
        file_id.alias("file_id"), F.concat(F.lit("webpage_"), F.sha2("url", 256), F.lit(".html")).alias("filename"),
        F.lit(".html").alias("file_type"), F.length(raw).cast("long").alias("file_size"),
        F.lit("web_crawl").alias("source_type"), now.alias("upload_date"), F.lit(True).alias("processed"),
        raw.alias("content"), F.to_json(about).alias("metadata"),
    )
    processed = good.select(
        SC.stable_id(file_id, prefix="data").alias("data_id"), file_id.alias("file_id"),
        F.lit("web_page").alias("content_type"), F.col("content").alias("extracted_text"),
        "word_count", "char_count", now.alias("processing_date"),
    )
    return files, processed
