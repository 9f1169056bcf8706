"""Pages, listings and archive indexes as DataFrames.  Nothing here fetches; pages come as files."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article main header footer nav aside blockquote".split())
_SKIP = frozenset(("script", "style", "noscript", "template"))
MAIN = ("article", "main")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.main, self.skip, self.inside, self.links, self.href, self.title, self.tag = [], [], 0, 0, [], None, [], ""
        self.label: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in MAIN:
            self.inside += 1
        if tag in _BLOCK:
            self._put("\n")
        if tag == "a":
            self.href, self.label = dict(attrs).get("href"), []
        self.tag = tag

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in _BLOCK:
            self._put("\n")
        if tag in MAIN:
            self.inside = max(0, self.inside - 1)
        if tag == "a" and self.href:
            self.links.append((self.href, " ".join("".join(self.label).split())))
            self.href = None
        self.tag = ""

    def handle_data(self, data):
        if self.skip:
            return
        if self.tag in ("h1", "title") and data.strip():
            self.title.append((self.tag, " ".join(data.split())))
        if self.href is not None:
            self.label.append(data)
        if self.tag != "title":
            self._put(data)

    def _put(self, s):
        self.out.append(s)
        if self.inside:
            self.main.append(s)


def parse_html(html: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, body text, links): h1, else the title up to its first spaced pipe, hyphen or dash; text of article or main, else of all."""
    p = _Text()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # a page that no parser reads has no text
        return "", "", []
    h1 = [t for k, t in p.title if k == "h1"]
    t = [t for k, t in p.title if k == "title"]
    title = h1[0] if h1 else re.split(r"\s[|\-—]\s", t[0])[0] if t else ""
    raw = "".join(p.main if any(x.strip() for x in p.main) else p.out)
    lines = [" ".join(x.split()) for x in raw.replace("­", "").split("\n")]
    return title, "\n".join(x for x in lines if x), p.links


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())])


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]))
def html_document(html: pd.Series) -> pd.DataFrame:
    rows = [parse_html(h) for h in html]
    return pd.DataFrame({"title": [r[0] for r in rows], "body": [r[1] for r in rows], "links": [[{"href": a, "label": b} for a, b in r[2]] for r in rows]})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, url, path) of an archive index with lines "timestamp url [status [type]]"; malformed lines, other states than 200 and other types than HTML are left out, the first capture of a path stays."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    ok = (F.coalesce(F.get("p", F.lit(2)), F.lit("200")) == "200") & (F.coalesce(F.get("p", F.lit(3)), F.lit("text/html")) == "text/html")
    lines = p.where(ok & F.col("p")[0].rlike(r"^\d+$")).select(F.col("p")[0].alias("timestamp"), https(F.col("p")[1]).alias("url"))
    return lines.groupBy(F.lower(F.rtrim(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("/"))).alias("path")).agg(F.min(F.struct("timestamp", "url")).alias("m")).select("m.timestamp", "m.url", "path")


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def absolute(base: Column, href: Column) -> Column:
    """Address of a link as a browser would join it, for absolute, rooted and relative references."""
    root = F.regexp_extract(base, "^([a-z]+://[^/]+)", 1)
    return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), href))


def page_urls(sites: DataFrame, pages: int, base: str = "url", param: str = "page", start: int = 1, pagination: str = "query_param") -> DataFrame:
    """(…, page, page_url): addresses of a paginated listing.

    ``query_param`` sets the parameter, in place of one that the address has;
    ``none`` has the first page only; other kinds raise an error.
    """
    if pagination == "none":
        return sites.withColumn("page", F.lit(start)).withColumn("page_url", F.col(base))
    if pagination != "query_param":
        raise ValueError(f"unknown pagination {pagination!r}")
    out = sites.withColumn("page", F.explode(F.sequence(F.lit(start), F.lit(start + pages - 1))))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(base), rf"(?<=[?&]){re.escape(param)}=[^&#]*&?", ""), r"[?&](?=#|$)", ""), "#.*$", "")
    sep = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    return out.withColumn("page_url", F.concat(bare, sep, F.lit(param + "="), F.col("page").cast("string")))


def listing(pages: DataFrame, url: str = "url", html: str = "html", must: str = r"/news", least_title: int = 15) -> DataFrame:
    """(listing_url, title, item_url) of the links of listing pages whose path matches ``must``, each address once with its longest label."""
    links = pages.select(F.col(url).alias("listing_url"), F.explode(html_document(F.col(html))["links"]).alias("l")).select("listing_url", F.col("l.label").alias("title"), absolute(F.col("listing_url"), F.col("l.href")).alias("item_url"))
    return links.where(F.col("item_url").rlike(must) & (F.length("title") >= least_title)).groupBy("listing_url", "item_url").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("title")).select("listing_url", "title", "item_url")


def until_old(items: DataFrame, since: str, page: str = "page", date: str = "date") -> DataFrame:
    """Items of the pages up to the first that is empty or older than ``since`` throughout; undated items count as new."""
    new = F.col(date).isNull() | (F.col(date) >= F.lit(since).cast("date"))
    stop = items.groupBy(page).agg(F.bool_or(new).alias("some")).where("NOT some").agg(F.min(page).alias("stop"))
    return items.crossJoin(F.broadcast(stop)).where(F.coalesce(F.col(page) < F.col("stop"), F.lit(True)) & new).drop("stop")
