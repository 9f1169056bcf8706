"""Listings, detail pages and archives of many sites, by rules.

A rule says where a site's pages keep title, body, date, items and links
(selectors of ``dom``), and how its addresses hold dates.  ``RULES`` has what
differs between offices; ``config.sites`` adds selectors of its own.  Pages are
rows (url, html); nothing here fetches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.sources import dom, sinks, web

#: Where pages keep their parts, unless a site's rule says otherwise.
BODY = ("article", "main", ".content", "#content", "body")
DATES = ("time[datetime]", "meta[property=article:published_time]")
MONTH_DATE = rf"((?:{X.MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}})"
#: What differs by state. ``within``: characters of the text in which a written date counts; ``url``: (pattern, form) of dates in addresses.
RULES: dict[str, dict] = {
    "PA": {"date": (".entry-date", "time", ".posted-on", ".ta-card-date")},
    "CT": {"title": (".content h3",), "date": ("p.date",), "text_date": (".content", r"(\d{2}/\d{2}/\d{4})")},
    "MA": {"date": (".ma__press-status__date",)},
    "IL": {"title": ("h2.presscontent",), "date": ("p.dateformat",), "url": ((r"/pressroom/\d{4}_\d{2}/(\d{8})", "yyyyMMdd"), (r"/pressroom/(\d{4}_\d{2})/", "yyyy_MM"))},
    "WA": {"date": ("time[datetime]",), "text_date": ("body", r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s+\d{4})"), "within": 500},
    "NY": {"url": ((r"/press-release/(\d{4}/\d{2})/", "yyyy/MM"), (r"/press-release/(\d{4})/", "yyyy"))},
    # listings
    "TX": {"must": r"/news/releases/"},
    "VA": {"must": r"/news", "least_title": 15, "skip_titles": r"(?i)^(?:news releases|press releases|media|newsroom|home)$"},
    "OTHER": {},
}
DETAIL = ["title", "body", "found", "written"]


def _detail(tree: dom.Node, rule: dict) -> tuple[str, str, list[str], str]:
    """(title, body, candidate dates in order, date written in the text)."""
    title = next((n.text().replace("\n", " ") for s in (*rule.get("title", ()), "h1") if (n := tree.first(s)) and n.text()), "")
    if not title and (t := tree.first("title")):
        title = re.split(r"\s[|\-—]\s", " ".join(t.text().split()))[0]
    body = next((n.text() for s in (*rule.get("body", ()), *BODY) if (n := tree.first(s)) and n.text()), tree.text())
    found = []
    for s in (*rule.get("date", ()), *DATES):
        if n := tree.first(s):
            found += [v for v in (n.attrs.get("datetime"), n.attrs.get("content"), n.text()) if v]
    written = ""
    where, pattern = rule.get("text_date", (None, MONTH_DATE))
    scope = (tree.first(where) if where else None) or None
    text = (scope.text() if scope else body)[: rule.get("within", 300) if where != ".content" else None]
    if m := re.search(pattern, text):
        written = m[1]
    return title, body, found, written


def details(pages: DataFrame, url: str = "url", html: str = "html", state: str = "state", rules: dict | None = None, date_format: str | None = None) -> DataFrame:
    """(…, title, body, date): the parts of detail pages by the rule of their state.

    The date is the first that can be read of: the rule's elements, time and
    meta elements, the text's opening, the address.  Pages without a title or
    body have empty ones, undated ones a null date.
    """
    table = {**RULES, **(rules or {})}
    out = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes) + ", title string, body string, found array<string>, written string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_detail(dom.parse(h), table.get(s or "", {})) for h, s in zip(b.column(html).to_pylist(), b.column(state).to_pylist())]
            cols = list(zip(*parts)) if parts else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())], names=[*b.schema.names, *DETAIL])

    p = pages.mapInArrow(run, out)
    dates = F.transform("found", lambda x: F.coalesce(X.iso_date(x), X.any_date(x, date_format)))
    in_url = F.lit(None).cast("date")
    for st, r in table.items():
        tries = []
        for pattern, form in r.get("url", ()):
            got = F.try_to_timestamp(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.lit(form)).cast("date")
            tries.append(F.date_add(got, 14) if form in ("yyyy/MM", "yyyy_MM") else F.make_date(F.year(got), F.lit(7), F.lit(1)) if form == "yyyy" else got)
        if tries:
            in_url = F.when(F.col(state) == st, F.coalesce(*tries)).otherwise(in_url)
    date = F.coalesce(F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)), X.any_date(F.col("written")), in_url)
    return p.select(*pages.columns, "title", "body", date.alias("date"))


def items(pages: DataFrame, url: str = "url", html: str = "html", state: str = "state", rules: dict | None = None) -> DataFrame:
    """(listing_url, state, title, item_url, date) of listing pages.

    rule: item, link, title, date (selectors; without ``item`` every link is an
    item), must (pattern of addresses), least_title, skip_titles.  Rows without
    a title or link are left out, pagination and date-only links too; an
    address counts once, with its longest title and the date that any of its
    links shows.
    """
    table = {**RULES, **(rules or {})}

    def run(batches):
        for b in batches:
            rows = []
            for u, h, s in zip(*(b.column(c).to_pylist() for c in (url, html, state))):
                rule, tree = table.get(s or "", {}), dom.parse(h)
                for n in tree.select(rule["item"]) if rule.get("item") else tree.select("a[href]"):
                    link = n if n.tag == "a" else n.first(rule.get("link", "a"))
                    label = n.first(rule["title"]) if rule.get("title") and n.tag != "a" else link
                    day = n.first(rule.get("date", "time")) if n.tag != "a" else None
                    if link is not None and link.attrs.get("href"):
                        rows.append((u, s, " ".join(label.text().split()) if label else "", link.attrs["href"], (day.attrs.get("datetime") or day.text()) if day else "", rule.get("must", ""), rule.get("least_title", 1), rule.get("skip_titles", r"^$")))
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[i], pa.int32() if i == 6 else pa.string()) for i in range(8)], names=["listing_url", "state", "title", "href", "day", "must", "least", "skip"])

    raw = pages.select(url, html, state).mapInArrow(run, "listing_url string, state string, title string, href string, day string, must string, least int, skip string")
    a = raw.withColumn("item_url", web.absolute(F.col("listing_url"), F.col("href"))).withColumn("label_date", X.any_date(F.col("title")))
    a = a.where(~F.lower("href").rlike(r"^(?:#|mailto:|tel:|javascript:)|[?&/]page[=/]\d+") & F.expr("item_url RLIKE must"))
    # a link whose label is a date only dates its twin
    date = F.coalesce(X.any_date(F.col("day")), X.iso_date(F.col("day")), F.col("label_date"))
    named = F.col("label_date").isNull() & (F.length("title") >= F.col("least")) & ~F.expr("title RLIKE skip") & ~F.col("title").rlike(r"^\d*$")
    one = a.groupBy("listing_url", "state", "item_url").agg(F.max(F.when(named, F.struct(F.length("title").alias("n"), F.col("title").alias("title")))).alias("t"), F.max(date).alias("date"))
    return one.where("t IS NOT NULL").select("listing_url", "state", "t.title", "item_url", "date")


def archive(index: DataFrame, pages: DataFrame, stored: DataFrame, state: str, exclude: tuple[str, ...] = (), rules: dict | None = None) -> DataFrame:
    """Rows to store of one state's archive: index (timestamp, url, path) → patterns out → what isn't stored → pages (url, html) → parts.

    Pages without a title or body are left out; each path counts once.
    """
    i = index if not exclude else index.where(~F.col("url").rlike("(?i)" + "|".join(f"(?:{p})" for p in exclude)))
    known = stored.select(F.lower(F.rtrim(F.try_parse_url(web.https(F.col("source_url")), F.lit("PATH")), F.lit("/"))).alias("path")).distinct()
    new = i.join(known, "path", "left_anti").select("url")
    p = pages.select(web.https(F.col("url")).alias("url"), "html").join(new, "url", "left_semi").withColumn("state", F.lit(state))
    return details(p, rules=rules).where("title <> '' AND body <> ''").select("state", "url", "title", "body", "date")


def scraped(listing: DataFrame, pages: DataFrame, since: str | None = None, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of bronze form, counts): the items of listing pages with their detail pages (url, html).

    counts: (state, found, fetched, missing, undated), one row per state.
    """
    found = items(listing, rules=rules)
    if since:
        found = found.where(F.col("date").isNull() | (F.col("date") >= F.lit(since).cast("date")))
    d = details(found.select(F.col("item_url").alias("url"), "state", F.col("title").alias("list_title"), F.col("date").alias("list_date")).join(pages.select("url", "html"), "url", "left"), rules=rules)
    rows = d.select("url", "state", F.coalesce(F.nullif("list_title", F.lit("")), "title").alias("headline"), F.when(F.col("html").isNotNull(), F.col("body")).alias("body"), F.coalesce("list_date", "date").alias("date"), F.col("html").isNotNull().alias("ok"))
    counts = rows.groupBy("state").agg(F.count("*").alias("found"), F.count_if("ok").alias("fetched"), F.count_if(~F.col("ok")).alias("missing"), F.count_if(F.col("date").isNull()).alias("undated"))
    return rows, counts


def seeded(pages: DataFrame, meta: DataFrame, today: str, most: int | None = 5000) -> DataFrame:
    """Bronze rows of stored page files (path, html) and what is known of them (fixture, state, title, date, url); ``most``: length of the stored body, None for all of it."""
    p = pages.select(F.element_at(F.split("path", "/"), -1).alias("fixture"), "html").join(meta, "fixture")
    d = details(p.withColumnRenamed("title", "known_title").withColumnRenamed("date", "known_date"))
    return sinks.bronze(d.select(F.col("url").alias("source_url"), "state", F.coalesce("known_date", "date").alias("date"), F.coalesce(F.nullif("known_title", F.lit("")), "title").alias("headline"), (F.substring("body", 1, most) if most else F.col("body")).alias("body")), today)
