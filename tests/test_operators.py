"""Matching, sources and ingestion on small cases and against brute force."""

import collections
import itertools
import json
import random
from datetime import date

from pyspark.sql import functions as F

from docketry import config
from docketry.operators import curate, graph, matching
from docketry.sources import dom, sinks, sites, web
from docketry.streaming import ingest


def test_labels(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("x", "x"), (None, "q"), ("a", "b")] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)], "a string, b string")
    got = {r.id: r.label for r in graph.labels(e, "a", "b").collect()}
    assert got["c"] == "a" and got["e"] == "d" and "x" not in got and {got[f"p{i:02d}"] for i in range(21)} == {"p00"}
    assert graph.labels(e.limit(0), "a", "b").count() == 0


def test_pairs_against_brute_force(spark):
    rows = [
        ("1", "CA", date(2024, 1, 1), "Acme settles", True, ["Acme Widgets"], 5.0),
        ("2", "NY", date(2025, 6, 1), "Acme settles", True, ["Widgets Acme"], 5.0),
        ("3", "CA", date(2024, 1, 20), "Other", False, ["Acme Widgets", "Bolt"], None),
        ("4", "CA", date(2024, 3, 20), "Other", False, ["Acme Widgets"], None),
        ("5", "CA", None, "Other", False, ["Acme Widgets"], None),
    ]
    c = spark.createDataFrame(rows, "id string, state string, date date, headline string, multistate boolean, defendants array<string>, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {(r.action_id_a, r.action_id_b): (r.match_type, r.reason) for r in matching.duplicate_pairs(c).collect()}
    assert got[("1", "2")] == ("multistate", "defendants=100%; date_diff=517d; exact_amount_match; headline=100%")
    # 1 and 3: 0.4 + 0.2 * (1 - 19 / 30) = 0.47 is too little
    assert set(got) == {("1", "2")}
    k = matching.clusters(matching.duplicate_pairs(c), c).collect()
    assert len(k) == 1 and k[0].lead_state == "CA" and k[0].states == "CA,NY" and float(k[0].total_amount) == 5.0


def test_pairs_of_a_frequent_defendant(spark):
    rows = [(f"{i:04d}", "CA", date(2024, 1, 1 + i % 28), "Ristigrasti settles", False, [["Ristigrasti Energy Group", "Ristigrasti Enrgy Grp"][i % 2]], 5.0) for i in range(70)]
    rows += [(f"w{i}", "CA", date(2024, 1, 1), "h", True, [n], None) for i, n in enumerate(["Abel Oil", "Abil Oils", "Zed"])]
    c = spark.createDataFrame(rows, "id string, state string, date date, headline string, multistate boolean, defendants array<string>, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {(r.action_id_a, r.action_id_b) for r in matching.duplicate_pairs(c).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if matching.token_sort(a[5][0], b[5][0]) >= 80}
    assert len(got) == 70 * 69 // 2 + 1


def test_bands(spark):
    r = spark.createDataFrame([("a", "CA", date(2024, 1, 1), 1000.0, "h", False), ("b", "NY", date(2024, 2, 1), 995.0, "h", False), ("c", "NY", date(2020, 2, 1), 995.0, "h", False), ("d", "NY", None, 10.0, "h", False)], "id string, state string, date date, amount double, headline string, multistate boolean").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = [(x.seed, x.states, x.members) for x in matching.bands(r).collect()]
    assert got == [("a", "CA,NY", 2), ("c", "NY", 1), ("d", "NY", 1)]


def greedy(rows, top, multi):
    """The bands by the plain loop."""
    left, out = sorted(rows, key=lambda r: (-r[3], r[2], r[0])), []
    while left and len(out) < top:
        s = left[0]
        tol, days = multi if s[5] else (0.01, 365)
        near = [r for r in left if r[0] == s[0] or s[3] * (1 - tol) <= r[3] <= s[3] * (1 + tol) and abs((r[2] - s[2]).days) <= days]
        states = {r[1] for r in near}
        out.append((s[0], ",".join(sorted(states)), len(near), len(states) > 1 or any(r[5] for r in near)))
        left = [r for r in left if r not in near]
    return out


def test_inclusive_bands_against_the_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"r{i:03d}", rng.choice(["CA", "NY", "TX"]), date(2018 + rng.randrange(7), 1 + rng.randrange(12), 1), float(rng.choice([100, 99, 101, 95, 105, 1000, 950, 1050, 2000])), "h", rng.random() < 0.3) for i in range(120)]
    r = spark.createDataFrame(rows, "id string, state string, date date, amount double, headline string, multistate boolean").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = [(x.seed, x.states, x.members, x.multistate) for x in matching.bands(r, top=15, multistate=(0.05, 1460), inclusive=True).orderBy("rank").collect()]
    assert got == greedy(rows, 15, (0.05, 1460))
    assert matching.bands(r.limit(0)).count() == 0


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(4)
    ks = sorted({" ".join(sorted("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))) for _ in range(120)})
    df = spark.createDataFrame([(k,) for k in ks], "key string")
    got = {(r.left_key, r.right_key, r.score) for r in matching.similar_names(df, df, 70).collect()}
    assert got == {(a, b, matching.token_sort(a, b)) for a in ks for b in ks if matching.token_sort(a, b) >= 70}


def test_resolve_config(spark, tmp_path, monkeypatch):
    (tmp_path / "entities.json").write_text('{"aliases": {"Fizz Labs": "Fizz"}, "entities": {"Fizz": {"entity_type": "company", "industry": "drinks", "sec_cik": 12}}}')
    (tmp_path / "defendant_blocklist.json").write_text('{"exact_matches": ["Some Office"], "patterns": ["^unit \\\\d+"]}')
    (tmp_path / "states.json").write_text('{"ca": {"code": "CA", "name": "California", "pagination": {"type": "query_param", "param": "page", "start": 0}, "selectors": {"title": "h2"}, "active": false}, "ny": {"code": "NY"}}')
    monkeypatch.setenv("DOCKETRY_CONFIG", str(tmp_path))
    n = spark.createDataFrame([("Fizz Labs Inc.",), ("Some Office",), ("Unit 7 Crew",), ("the parties",), ("Fizzy Labz",)], "raw_name string")
    known = spark.createDataFrame([("Fuzzo Labs",)], "name string")
    got = {r.raw_name: r for r in matching.resolve(n, known, config.aliases(spark), config.metadata(spark)).collect()}
    assert (got["Fizz Labs Inc."].canonical_name, got["Fizz Labs Inc."].industry, got["Fizz Labs Inc."].sec_cik) == ("Fizz", "drinks", "12")
    assert got["Some Office"].how == got["Unit 7 Crew"].how == "invalid" and got["Fizzy Labz"].candidate == "Fuzzo Labs" and got["Fizzy Labz"].score == 70
    assert got["Fizzy Labz"].how == "review" and got["Fizzy Labz"].canonical_name == "Fizzy Labz"
    assert {r.key: (r.active, r.pagination) for r in config.sites(spark).collect()} == {"ca": (False, "query_param"), "ny": (True, "none")}
    d = spark.createDataFrame([("1", "Fizz Labs Inc.", ""), ("2", "Some Office", None), ("3", "Fizz Labs Inc.", "Kept")], "id string, raw_name string, canonical_name string")
    found = matching.resolve(d, known, config.aliases(spark))
    assert {r.id: r.canonical_name for r in matching.resolved(d, found, keep_empty=True).collect()} == {"1": "Fizz", "2": None, "3": "Kept"}
    assert {r.id: r.canonical_name for r in matching.resolved(d, found).collect()} == {"1": "Fizz", "2": "", "3": "Kept"}


def test_link_back(spark):
    a = spark.createDataFrame([("1", "CA", date(2024, 1, 1), "h", True), ("2", "NY", date(2024, 1, 2), "h", True), ("3", "TX", date(2024, 1, 2), "other", False)], "id string, state string, date_announced date, headline string, is_multistate boolean")
    links = spark.createDataFrame([("1", "d"), ("2", "d"), ("3", "d")], "action_id string, defendant_id string")
    names = spark.createDataFrame([("d", "Acme Widgets", None)], "id string, raw_name string, canonical_name string")
    money = spark.createDataFrame([("1", 5.0)], "action_id string, total_amount double").withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    rows, linked = matching.link_back(a, links, names, money)
    m = rows.collect()
    got = {r.id: r.multistate_action_id for r in linked.collect()}
    assert len(m) == 1 and m[0].lead_state == "CA" and got == {"1": m[0].id, "2": m[0].id, "3": None}


def test_curation_against_the_plain_loop(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        rows.append((f"i{i:03d}", rng.choice(["CA", "NY", "ZZ"]), date(2023, 1, 1), ["P"], "x", f"h{rng.randrange(60)}", sorted(rng.sample(["antitrust", "healthcare", "other"], rng.randint(0, 2))), rng.choice(["settlement", "injunction", "consent_decree"]), "", rng.random() < 0.3, "u", rng.choice(["large", "mid", "small", "none"]), round(rng.random() * 3, 3), f"h{rng.randrange(60)}"))
    names = "id string, state string, date date, parties array<string>, industry string, headline string, categories array<string>, action_type string, settlement_amount string, is_multistate boolean, source_url string, bucket string, worth double, headline_key string"
    got = {r.id: r["rank"] for r in curate.choose(spark.createDataFrame(rows, names), ("CA", "NY"), rounds=30).collect()}
    count, keys, want = collections.Counter(), set(), {}
    step = lambda t, n: next((w for below, w in t if n < below), 0)
    while len(want) < 30:
        best, top = None, -1e9
        for r in rows:
            if r[0] in want or r[13] in keys:
                continue
            s = r[12] + (step(curate.STATE, count["s", r[1]]) if r[1] in ("CA", "NY") else -5) + sum(step(curate.CATEGORY, count["c", c]) for c in r[6])
            s += step(curate.TYPE.get(r[7], curate.TYPE[None]), count["t", r[7]]) + (curate.BUCKET[r[11]][1] if count["b", r[11]] < curate.BUCKET[r[11]][0] else 0) + (3 if r[9] and count["m"] < 12 else 0)
            if s > top:
                best, top = r, s
        if best is None:
            break
        want[best[0]] = len(want) + 1
        keys.add(best[13])
        count.update([("s", best[1]), ("t", best[7]), ("b", best[11]), *(("c", c) for c in best[6]), *(["m"] if best[9] else [])])
    assert got == want


def test_resolve(spark):
    n = spark.createDataFrame([("The Acme Widgets Inc.",), ("Acme Widgts",), ("Bolt Energy LLC",), ("The Company",), (None,), ("FBK",)], "raw_name string")
    known = spark.createDataFrame([("Acme Widgets",)], "name string")
    alias = spark.createDataFrame([("fbk", "Facebook")], "alias string, name string")
    got = {r.raw_name: (r.canonical_name, r.how) for r in matching.resolve(n, known, alias).collect()}
    assert got["The Acme Widgets Inc."] == ("Acme Widgets", "exact") and got["Acme Widgts"] == ("Acme Widgets", "fuzzy")
    assert got["Bolt Energy LLC"] == ("Bolt Energy", "new") and got["The Company"] == ("", "invalid") and got["FBK"] == ("Facebook", "exact")


def test_html():
    title, body, links = web.parse_html("<html><head><title>Big News | Office</title><script>x</script></head><body><nav><a href='/a'>Menu</a></nav><main><p>One &amp; two</p><p>Th­ree</p></main></body>")
    assert title == "Big News" and body == "One & two\nThree" and links == [("/a", "Menu")]
    assert web.parse_html(None) == ("", "", [])


def test_selectors():
    t = dom.parse("<div class='content big'><h3>Big <b>Day</b></h3><p class=date>May 5, 2024</p><ul><li><a href='/x'>One</a><li><a href='/y'>Two</a></ul></div><p>out<script>no</script>")
    assert t.first(".content h3").text() == "Big Day" and t.first("p.date").text() == "May 5, 2024" and t.first("h1, .big p").text() == "May 5, 2024"
    assert [n.attrs["href"] for n in t.select("a[href]")] == ["/x", "/y"] and t.first("a[href=/y]").text() == "Two" and t.first("#none") is None
    assert dom.parse(None).text() == "" and "no" not in t.text()


def test_details(spark):
    rows = [
        ("CT", "https://a.example/1", "<title>T | Office</title><div class=content><h3>Ct title</h3>Press\n03/04/2024 text</div>"),
        ("IL", "https://a.example/pressroom/2023_05/20230507.html", "<h2 class=presscontent>Il</h2><main>Body</main>"),
        ("IL", "https://a.example/pressroom/2023_05/x.html", "<h1>Il two</h1><main>Body</main>"),
        ("MA", "https://a.example/2", "<h1>Ma</h1><div class='ma__press-status__date'>10/09/2024</div><article>Body</article>"),
        ("WA", "https://a.example/3", "<h1>Wa</h1><time datetime='2026-02-03T18:55:01-08:00'>x</time><article>Body</article>"),
        ("ZZ", "https://a.example/4", "<h1>Zz</h1><meta property='article:published_time' content='2021-07-08T00:00:00Z'><article>Body</article>"),
        ("ZZ", "https://a.example/5", "<h1>Zz</h1><article>February 11, 2026 | Press Release. Body</article>"),
        ("NY", "https://ag.example/press-release/2022/slug", "<h1>Ny</h1><article>Body</article>"),
        (None, "u", None),
    ]
    got = [(r.title, str(r.date)) for r in sites.details(spark.createDataFrame(rows, "state string, url string, html string")).collect()]
    assert got == [("Ct title", "2024-03-04"), ("Il", "2023-05-07"), ("Il two", "2023-05-15"), ("Ma", "2024-10-09"), ("Wa", "2026-02-03"), ("Zz", "2021-07-08"), ("Zz", "2026-02-11"), ("Ny", "2022-07-01"), ("", "None")]


def test_items(spark):
    pages = [
        ("https://t.example/n", "TX", "<a href='/news/releases/a'>A release of ours</a><a href='/about'>About</a><a href='?page=2'>Next</a>"),
        ("https://p.example/n", "PA", "<a href='/x'>Some news here</a><a href='/x'>May 5, 2024</a><a href='#top'>Top of page</a>"),
        ("https://v.example/n", "VA", "<a href='/news/1'>Short</a><a href='/news/2'>A title that is long enough</a><a href='/else/3'>A title that is elsewhere</a>"),
        ("https://c.example/n", "CA", "<div class=row><h2><a href='/r/1'>One</a></h2><span class=d>June 1, 2024</span></div><div class=row><p>none</p></div>"),
    ]
    got = {(r.state, r.title, r.item_url, str(r.date)) for r in sites.items(spark.createDataFrame(pages, "url string, state string, html string"), rules={"CA": {"item": ".row", "title": "h2 a", "date": ".d"}}).collect()}
    assert got == {("TX", "A release of ours", "https://t.example/news/releases/a", "None"), ("PA", "Some news here", "https://p.example/x", "2024-05-05"), ("VA", "A title that is long enough", "https://v.example/news/2", "None"), ("CA", "One", "https://c.example/r/1", "2024-06-01")}


def test_archive_and_seeds(spark):
    index = spark.createDataFrame([("1", "https://a.example/n/one", "/n/one"), ("2", "https://a.example/n/two", "/n/two"), ("3", "https://a.example/tag/x", "/tag/x")], "timestamp string, url string, path string")
    pages = spark.createDataFrame([("http://a.example/n/one", "<h1>One</h1><main>B</main>"), ("http://a.example/n/two", "<h1>Two</h1><main>B</main>"), ("http://a.example/tag/x", "<h1>X</h1><main>B</main>")], "url string, html string")
    stored = spark.createDataFrame([("http://a.example/n/two/",)], "source_url string")
    assert [r.title for r in sites.archive(index, pages, stored, "CA", ("/tag/",)).collect()] == ["One"]
    meta = spark.createDataFrame([("p.html", "ca", None, None, "u1")], "fixture string, state string, title string, date date, url string")
    r = sites.seeded(spark.createDataFrame([("file:/d/p.html", "<h1>Hi</h1><main>Some body</main>")], "path string, html string"), meta, "2026-01-01", most=4).collect()[0]
    assert (r.state, r.headline, r.raw_text, str(r.date_announced), r.action_type) == ("CA", "Hi", "Some", "2026-01-01", "other")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.5, date(2024, 1, 1)), ("2", None, None)], "id string, v double, d date")
    sinks.write_document(df, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert sinks.read_document(text) == {"count": 2, "actions": [{"id": "1", "v": 2.5, "d": "2024-01-01"}, {"id": "2", "v": None, "d": None}]} and json.loads(text)
    sinks.write_pages(spark.createDataFrame([("https://x.example/news/a-b?x=1", "<p>")], "url string, html string"), str(tmp_path / "raw"))
    assert [r.name for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == ["news_a_b"]
    m = sinks.merged(spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "source_url string, headline string, n int"), spark.createDataFrame([("u1", "new"), ("u9", "z"), ("u2", None)], "source_url string, headline string"))
    assert sorted(map(tuple, m.collect())) == [("u1", "new", 1), ("u2", "b", 2)]
    u = web.page_urls(spark.createDataFrame([("https://x.example/n?page=7&y=1",), ("https://x.example/n?page=7",)], "url string"), 1, start=0).collect()
    assert [x.page_url for x in u] == ["https://x.example/n?y=1&page=0", "https://x.example/n?page=0"]


def test_sources(spark, tmp_path):
    (tmp_path / "index.txt").write_text("20240101 http://x.example/News/a/\n20230101 https://x.example/news/a\nbroken\n")
    got = web.read_index(spark, str(tmp_path / "index.txt")).collect()
    assert len(got) == 1 and got[0].timestamp == "20230101"
    urls = web.page_urls(spark.createDataFrame([("https://x.example/n?y=1",)], "url string"), 2).collect()
    assert [u.page_url for u in urls] == ["https://x.example/n?y=1&page=1", "https://x.example/n?y=1&page=2"]
    items = spark.createDataFrame([(1, "a", date(2024, 1, 1)), (2, "b", date(2020, 1, 1)), (3, "c", date(2024, 1, 1)), (1, "d", None)], "page int, k string, date date")
    assert {r.k for r in web.until_old(items, "2023-01-01").collect()} == {"a", "d"}


def test_incremental(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "1.json").write_text('{"source_url": "u1", "v": 1}\n{"source_url": "u1", "v": 2}\n{"source_url": null, "v": 3}\n')

    def run():
        s = spark.readStream.schema("source_url string, v int").json(str(src))
        ingest.ingest(s, store, str(tmp_path / "ck")).awaitTermination()
        return sorted((r.source_url, r.v) for r in spark.read.parquet(store).collect())

    assert run() == [("u1", 1)]
    (src / "2.json").write_text('{"source_url": "u1", "v": 9}\n{"source_url": "u2", "v": 4}\n')
    assert run() == [("u1", 1), ("u2", 4)]


def test_replaced(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "action_id string, category string")
    new = spark.createDataFrame([("1", "c", 0.5)], "action_id string, category string, confidence double")
    got = sorted(tuple(r) for r in sinks.replaced(old, new, spark.createDataFrame([("1",)], "action_id string")).collect())
    assert got == [("1", "c", 0.5), ("2", "b", None)]
