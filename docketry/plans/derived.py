"""Queries over the extraction, matching, source and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import config
from docketry.functions import fixed
from docketry.functions import text as X
from docketry.operators import extract as E
from docketry.operators import curate, graph, matching
from docketry.plans import api
from docketry.plans.catalog import ACTIVE, ENFORCEMENT
from docketry.sources import sinks, sites, web
from docketry.streaming import ingest
from docketry.tables import load


def _actions(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "enforcement_actions")


def i09_dollar_amounts(s, d):
    a = X.dollar_amounts(F.col("raw_text"))
    return _actions(s, d).select("id", F.size(a).cast("bigint").alias("n"), F.coalesce(F.aggregate(a, F.lit(0.0), lambda t, x: t + x["amount"].cast("double")), F.lit(0.0)).alias("total"))


def i10_largest_amount(s, d):
    return _actions(s, d).select("id", X.largest(X.dollar_amounts(F.col("raw_text")))["amount"].cast("double").alias("largest"))


def i12_settlement_amount(s, d):
    return _actions(s, d).select("id", X.settlement_amount(F.col("headline"), F.col("raw_text")).alias("a")).select("id", "a.raw", "a.amount", "a.is_estimated")


def i13_components(s, d):
    return _actions(s, d).select("id", *[X.component(F.col("raw_text"), c).cast("double").alias(c) for c in X.COMPONENTS])


def i14_dates(s, d):
    t = F.col("raw_text")
    return _actions(s, d).select("id", X.announced_date(t).alias("announced"), X.filed_date(t).alias("filed"), X.resolved_date(t).alias("resolved"), X.url_date(F.col("source_url")).alias("in_url"))


def i16_statutes(s, d):
    return _actions(s, d).select("id", F.explode(X.statutes(F.col("raw_text"))).alias("x")).select("id", "x.*")


def i18_parties(s, d):
    return _actions(s, d).select("id", F.explode(E.parties_of(F.col("headline"), F.col("raw_text"))).alias("party"))


def i22_summary(s, d):
    return _actions(s, d).select("id", X.summary(F.col("raw_text")).alias("summary"))


def j02_patterns(s, d):
    h, b = F.col("headline"), F.col("raw_text")
    t = F.concat(F.coalesce(h, F.lit("")), F.lit(" "), F.coalesce(b, F.lit("")))
    return _actions(s, d).select("id", t.rlike(X.HAS_DOLLAR).alias("dollar"), t.rlike(X.HAS_STATUTE).alias("statute"), t.rlike(X.HAS_COURT).alias("court"), t.rlike(X.HAS_DEFENDANT).alias("defendant"))


def j04_action_type(s, d):
    k = X.action_type(F.col("headline"), F.col("raw_text"))
    return _actions(s, d).select("id", k.alias("kind")).select("id", "kind", X.status_of(F.col("kind")).alias("status"))


def j06_multistate(s, d):
    return _actions(s, d).select("id", X.is_multistate(F.col("headline"), F.col("raw_text")).alias("multistate"))


def j07_categories(s, d):
    return _actions(s, d).select("id", F.explode(X.categories(F.col("headline"), F.col("raw_text"))).alias("c")).select("id", "c.category", "c.subcategory", "c.confidence")


def j11_extract(s, d):
    return E.extract(_actions(s, d)).select("id", F.col("verdict.is_enforcement").alias("is_enforcement"), F.col("verdict.stage").alias("stage"), F.col("settlement.total_amount").cast("double").alias("settlement"), "date_announced", "action_type", "status", "is_multistate", F.col("amount.amount").cast("double").alias("amount"), F.size("defendants").alias("parties"), F.size("statutes").alias("statutes"), "quality_score")


def k01_clean_names(s, d):
    return load(s, d, "defendants").select("id", matching.clean_name(F.col("raw_name")).alias("cleaned"))


def _resolved(s, d):
    n = load(s, d, "defendants")
    known = n.where("canonical_name <> ''").select(F.col("canonical_name").alias("name")).distinct()
    return n, matching.resolve(n, known, config.aliases(s), config.metadata(s))


def k04_resolve(s, d):
    """Every raw name against all stored canonical names and the configured aliases."""
    return _resolved(s, d)[1].drop("candidate", "score")


def k05_review(s, d):
    """Names that may be another one's variant: to be looked at, the likeliest first."""
    return _resolved(s, d)[1].where("how = 'review'").select("raw_name", "candidate", "score").orderBy(F.desc("score"), "raw_name")


def m09_resolved(s, d):
    """Defendants with the empty canonical names filled; those that resolve to nothing stay as they are."""
    n, found = _resolved(s, d)
    return matching.resolved(n, found, keep_empty=True).select("id", "raw_name", "canonical_name")


def k10_token_sort(s, d):
    n = load(s, d, "defendants").where("canonical_name <> ''")
    return n.select("id", matching.token_sort_ratio("raw_name", "canonical_name").alias("score"))


def _cand(s, d):
    return matching.candidates(_actions(s, d), load(s, d, "action_defendants"), load(s, d, "defendants"), load(s, d, "monetary_terms"))


def l04_duplicate_pairs(s, d):
    return matching.duplicate_pairs(_cand(s, d))


def l05_clusters(s, d):
    pairs = load(s, d, "dedup_matches").where("match_type = 'multistate' AND action_id_a <> '' AND action_id_b <> ''").select(F.lower(F.trim("action_id_a")).alias("action_id_a"), F.lower(F.trim("action_id_b")).alias("action_id_b"), "match_type")
    return matching.clusters(pairs, _cand(s, d))


def l05_labels(s, d):
    m = load(s, d, "dedup_matches").where("match_type = 'multistate' AND action_id_a <> '' AND action_id_b <> ''")
    return graph.labels(m, "action_id_a", "action_id_b")


def _amounts(s, d, scope):
    m = load(s, d, "monetary_terms").select(F.col("action_id").alias("id"), F.col("total_amount").alias("amount"))
    a = _actions(s, d).where(scope).select("id", "state", F.col("date_announced").alias("date"), "headline", F.col("is_multistate").alias("multistate"))
    return a.join(m, "id")


def o22_largest_settlements(s, d):
    """The ten largest settlements, records of one settlement together."""
    return matching.bands(_amounts(s, d, ACTIVE))


def o23_top_multistate(s, d):
    return o22_largest_settlements(s, d).where("multistate").orderBy("rank")


def o33_dash_settlements(s, d):
    """Bands with wider tolerances around multistate seeds, over headlines that are settlements; of groups that show the same amount the first stays."""
    clean = _amounts(s, d, ENFORCEMENT).where(F.col("headline").isNotNull() & (F.col("headline") != "") & ~F.col("headline").rlike(fixed.any_of(fixed.NO_SETTLEMENT_HEADLINES)))
    b = matching.bands(clean, top=20, multistate=(0.05, 1460), inclusive=True).withColumn("label", X.amount_label(F.col("amount"), "dashboard"))
    one = b.groupBy("label").agg(F.min(F.struct("rank", "seed", "headline", "date", "amount", "states", "members", "multistate")).alias("g")).select("g.*", "label")
    return one.withColumn("headline", X.headline_display(F.col("headline"))).orderBy("rank").limit(10)


def l07_settlement_bands(s, d):
    return matching.bands(_amounts(s, d, ENFORCEMENT))


def l10_headline_first(s, d):
    return _actions(s, d).where("headline IS NOT NULL").groupBy("headline").agg(F.min(F.struct("date_announced", "id")).alias("f"), F.count("*").cast("bigint").alias("n")).select("headline", F.col("f.id").alias("first_id"), "n")


def _html(s, d):
    body = F.array_join(F.transform(F.filter(F.split(F.coalesce("raw_text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))), "")
    head = F.replace(F.replace(F.coalesce("headline", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return _actions(s, d).select("id", F.col("source_url").alias("url"), F.concat(F.lit("<html><head><title>"), head, F.lit(" | Newsroom</title></head><body><nav><a href='/news'>News</a></nav><article><h1>"), head, F.lit("</h1>"), body, F.lit("<a href='/news/"), "id", F.lit("'>Read the full release here</a></article></body></html>")).alias("html"))


def i02_html_documents(s, d):
    """Every release as a page and back: title, length of the text, links."""
    x = _html(s, d).select("id", web.html_document(F.col("html")).alias("x"))
    return x.select("id", F.col("x.title").alias("title"), F.length("x.body").alias("chars"), F.size("x.links").alias("links"))


def i04_listing_links(s, d):
    return web.listing(_html(s, d), must=r"/news/")


def m01_new_rows(s, d):
    """Rows of the later half that an incremental load would add."""
    a = _actions(s, d).select("source_url", "id", "headline", "created_at")
    return sinks.new_only(a, a.where(F.col("created_at") < "2023-01-01")).select("source_url", "id")


def x02_tumbling(s, d):
    return ingest.tumbling(s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).select("start", "event_type", F.col("n").cast("bigint").alias("n"))


def x03_sessions(s, d):
    return ingest.sessions(s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.col("start").alias("first_ts"), F.col("n").cast("bigint").alias("n"))


# --- filter, processing and updates ----------------------------------------------
def j01_verdict(s, d):
    return _actions(s, d).select("id", X.verdict(F.col("headline"), F.col("raw_text")).alias("v")).select("id", "v.is_enforcement", "v.stage")


def _waiting(s, d):
    """The stored actions as a fresh load has them: none is processed."""
    return _actions(s, d).withColumn("quality_score", F.lit(0.0))


def m06_processed(s, d):
    """All actions extracted anew: type, status and score, rejected ones marked."""
    return E.processed(_waiting(s, d))[0].select("id", "action_type", "status", "is_multistate", "quality_score")


def m06_children(s, d):
    """Rows of each child table that the extraction makes, a defendant for every mention."""
    star = E.star(E.processed(_waiting(s, d))[1], per_mention=True)
    out = None
    for name, t in star.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def m07_reset(s, d):
    """Rows and waiting rows of each table after a reset."""
    names = ("enforcement_actions", "defendants", "action_defendants", "violation_categories", "monetary_terms")
    t = E.reset({n: load(s, d, n) for n in names})
    out = None
    for n in names:
        wait = F.count_if(F.col("quality_score") == 0.0) if n == names[0] else F.lit(0).cast("bigint")
        one = t[n].agg(F.count("*").alias("n"), F.max(F.lit(0)).alias("_"), wait.alias("waiting") if n == names[0] else F.count_if(F.lit(False)).alias("waiting")).select(F.lit(n).alias("name"), "n", "waiting")
        out = one if out is None else out.unionByName(one)
    return out


def m08_backfilled(s, d):
    """Dates after the sentinel (here the most frequent stored date) gave way to dates of text and address."""
    a = _actions(s, d)
    top = a.groupBy("date_announced").count().orderBy(F.desc("count"), "date_announced").limit(1).collect()
    day = str(top[0][0]) if top and top[0][0] else "2022-01-01"
    return E.backfilled(a, day).select("id", "date_announced")


def m10_merged(s, d):
    """Stored rows after a second scrape brought longer headlines of the earlier half."""
    a = _actions(s, d).select("source_url", "id", "headline", "created_at")
    fresh = a.where(F.col("created_at") < "2023-01-01").select("source_url", F.concat(F.col("headline"), F.lit(" (updated)")).alias("headline"))
    return sinks.merged(a, fresh).select("id", "headline")


def l06_linked(s, d):
    """Clusters of multistate actions that are linked back, with the actions that point to them."""
    rows, linked = matching.link_back(_actions(s, d), load(s, d, "action_defendants"), load(s, d, "defendants"), load(s, d, "monetary_terms"))
    n = linked.where("multistate_action_id IS NOT NULL").groupBy(F.col("multistate_action_id").alias("id")).agg(F.count("*").cast("bigint").alias("actions"))
    return rows.join(n, "id").select("id", "name", "lead_state", F.array_join("participating_states", ",").alias("states"), F.col("total_settlement").cast("double").alias("total"), "actions")


# --- interface ----------------------------------------------------------------------
def o05_nested_actions(s, d):
    """The second page of one state's actions with their children."""
    return api.list_actions(s, d, limit=25, offset=25, state="ca", since="2019-01-01")


def o05_search(s, d):
    """All filters at once, search texts with signs that LIKE knows."""
    a = api.filtered(s, d, state="CA", category="consumer_protection", defendant="a", since="2018-01-01", until="2026-12-31", min_amount=1000, q="t")
    return a.select("id", "state", "date_announced", "headline")


def o06_nested_action(s, d):
    """Every action with its body and children as structs."""
    n = api.nested(_actions(s, d), s, d, body=True)
    return n.select("id", F.size("defendants").cast("bigint").alias("defendants"), F.size("categories").cast("bigint").alias("categories"), F.col("monetary_terms.total_amount").alias("total_amount"), F.length("raw_text").cast("bigint").alias("chars"))


def o13_quarters_of(s, d):
    return api.timeline(s, d, "quarter", state="TX", category="healthcare")


def o49_sample(s, d):
    """The curated sample: 65 diverse records of good quality."""
    r = curate.records(_actions(s, d), load(s, d, "action_defendants"), load(s, d, "defendants"), load(s, d, "violation_categories"), load(s, d, "monetary_terms"))
    return curate.sample_table(curate.choose(r, ("CA", "NY", "WA", "TX", "MA", "OH", "OR")))


# --- labels --------------------------------------------------------------------------
def h04_amount_variants(s, d):
    m = load(s, d, "monetary_terms")
    return m.select("action_id", *[X.amount_label(F.col("total_amount"), k).alias(k) for k in ("report", "dashboard", "search", "sample", "clean")])


def h06_headlines(s, d):
    return _actions(s, d).select("id", X.headline_display(F.col("headline")).alias("display"), curate.headline_short(F.col("headline")).alias("short"))


def h09_categories(s, d):
    c = load(s, d, "violation_categories").groupBy("action_id").agg(F.collect_set("category").alias("c"))
    return c.select("action_id", F.array_join(X.first_categories(F.col("c")), "; ").alias("categories"))


def h23_years(s, d):
    a = _actions(s, d).groupBy(F.year("date_announced").alias("y")).agg(F.count("*").cast("bigint").alias("actions"))
    return a.select(X.year_label(F.col("y"), F.lit("2026-07-01").cast("date")).alias("year"), "actions")


# --- pages -----------------------------------------------------------------------------
def _pages(s, d):
    return _html(s, d).join(_actions(s, d).select("id", "state", F.date_format("date_announced", "yyyy-MM-dd").alias("day")), "id").select("id", "state", "url", F.replace("html", F.lit("<article>"), F.concat(F.lit("<time datetime='"), F.coalesce("day", F.lit("")), F.lit("T08:00:00-08:00'></time><article>"))).alias("html"))


def i03_details(s, d):
    """Parts of the detail pages by the rule of their state."""
    return sites.details(_pages(s, d)).select("id", "title", F.length("body").alias("chars"), "date")


def a11_archive(s, d):
    """What an archive of one state's pages adds to the rows stored before 2023."""
    p = _pages(s, d).where("state = 'CA'")
    index = p.select(F.lit("20240101000000").alias("timestamp"), web.https(F.col("url")).alias("url"), F.lower(F.rtrim(F.try_parse_url(web.https(F.col("url")), F.lit("PATH")), F.lit("/"))).alias("path"))
    stored = _actions(s, d).where("created_at < '2023-01-01'").select("source_url")
    return sites.archive(index, p, stored, "CA").select("state", "url", "title", "date")


def a08_scraped(s, d):
    """Counts of a scrape: listing pages of all states, detail pages of half."""
    h = _pages(s, d)
    lists = h.groupBy("state").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<li><a href='"), F.col("url"), F.lit("'>Release of the office "), "id", F.lit("</a></li>")))), "").alias("l")).select("state", F.concat(F.lit("https://list.example/"), "state").alias("url"), F.concat(F.lit("<ul>"), "l", F.lit("</ul>")).alias("html"))
    return sites.scraped(lists, h.where(F.pmod(F.hash("id"), F.lit(2)) == 0), rules={"TX": {}, "VA": {}})[1]


QUERIES = {f.__name__: f for f in (
    i02_html_documents, i03_details, i04_listing_links, i09_dollar_amounts, i10_largest_amount, i12_settlement_amount, i13_components, i14_dates, i16_statutes, i18_parties, i22_summary, j01_verdict, j02_patterns, j04_action_type, j06_multistate, j07_categories, j11_extract, k01_clean_names, k04_resolve, k05_review, k10_token_sort,
    l04_duplicate_pairs, l05_clusters, l05_labels, l06_linked, l07_settlement_bands, o05_nested_actions, o05_search, o06_nested_action, o13_quarters_of, o22_largest_settlements, o23_top_multistate, o33_dash_settlements, o49_sample, l10_headline_first, m01_new_rows, m06_processed, m06_children, m07_reset, m08_backfilled, m09_resolved, m10_merged,
    h04_amount_variants, h06_headlines, h09_categories, h23_years, a08_scraped, a11_archive, x02_tumbling, x03_sessions,
)}


def _re(p: str) -> str:
    """A pattern as a literal of the checking engine."""
    return "'" + p.replace("'", "''") + "'"


def _kind() -> str:
    parts = []
    for text in ("coalesce(headline, '')", "substr(coalesce(raw_text, ''), 1, 2000)", "substr(coalesce(raw_text, ''), 1, 5000)"):
        parts.append("CASE " + " ".join(f"WHEN regexp_matches({text}, {_re(p)}) THEN '{n}'" for n, p in X.ACTION_TYPES.items()) + " END")
    return "coalesce(" + ", ".join(parts) + ", 'other')"


_TEXT = "coalesce(headline, '') || ' ' || coalesce(raw_text, '')"
_AMOUNTS = rf"""
WITH m AS (SELECT id, unnest(regexp_extract_all(raw_text, {_re(X.DOLLAR_WORDS + '([MBKmbk]([^A-Za-z]|$))?')}, 0)) AS raw FROM enforcement_actions),
v AS (SELECT id, TRY_CAST(replace(regexp_extract(raw, '[0-9,]+(?:\.[0-9]+)?'), ',', '') AS DECIMAL(20,4)) * CASE WHEN regexp_matches(raw, '(?i)thousand|[0-9.,]\s*k([^a-z]|$)') THEN 1000 WHEN regexp_matches(raw, '(?i)million|[0-9.,]\s*m([^a-z]|$)') THEN 1000000 WHEN regexp_matches(raw, '(?i)billion|[0-9.,]\s*b([^a-z]|$)') THEN 1000000000 ELSE 1 END AS amount FROM m)
"""
def _words(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _verdict() -> str:
    opening = "lower(coalesce(headline, '') || ' ' || substr(coalesce(raw_text, ''), 1, 500))"
    pattern = f"regexp_matches({_TEXT}, {_re(X.HAS_DEFENDANT)}) AND (regexp_matches({_TEXT}, {_re(X.HAS_DOLLAR)}) OR regexp_matches({_TEXT}, {_re(X.HAS_STATUTE)}) OR regexp_matches({_TEXT}, {_re(X.HAS_COURT)}))"
    screen = f"CASE WHEN regexp_matches(coalesce(headline, ''), {_re(fixed.any_of(fixed.OTHER_HEADLINES))}) THEN 'reject' WHEN {_words(opening, fixed.ENFORCEMENT_WORDS)} THEN 'pass' WHEN {_words(opening, fixed.OTHER_WORDS)} THEN 'reject' ELSE 'ambiguous' END"
    return f"SELECT id, s <> 'reject' AND p AS is_enforcement, CASE WHEN s = 'reject' THEN 'keyword_reject' WHEN p AND s = 'pass' THEN 'pattern_pass' WHEN p THEN 'pattern_pass_ambiguous' WHEN s = 'pass' THEN 'keyword_pass_no_pattern' ELSE 'pattern_reject' END AS stage FROM (SELECT id, {screen} AS s, {pattern} AS p FROM enforcement_actions)"


def _statutes() -> str:
    each = " UNION ALL ".join(f"SELECT id, {i} AS k, unnest(regexp_extract_all(coalesce(raw_text, ''), {_re(p)})) AS raw FROM enforcement_actions" for i, p in enumerate(X.STATUTES))
    name = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw), {_re('(?i)' + p)}) THEN '{n}'" for p, n in fixed.LAW_NAMES) + " ELSE '' END"
    return f"SELECT id, raw AS statute_raw, {name} AS statute_name, {_words('lower(raw)', fixed.STATE_LAW)} AS is_state_statute, {_words('lower(raw)', fixed.FEDERAL_LAW)} AS is_federal_statute FROM (SELECT DISTINCT id, trim(raw) AS raw FROM ({each}))"


def _categories() -> str:
    parts = []
    for c, ws in X.TAXONOMY.items():
        hits = " + ".join("CAST(regexp_matches(t, " + _re(r"\b" + w.replace(".", r"\.") + r"\b") + ") AS INT)" for w in ws)
        subs = "".join(f" WHEN {_sub(n)} THEN " + _re(n) for n in X.SUBCATEGORIES.get(c, ()))
        parts.append(f"SELECT id, '{c}' AS category, {'CASE' + subs + ' END' if subs else 'NULL'} AS subcategory, {hits} AS n FROM t")
    return f"WITH t AS (SELECT id, lower({_TEXT}) AS t FROM enforcement_actions), h AS ({' UNION ALL '.join(parts)}), k AS (SELECT * FROM h WHERE n > 0) SELECT id, category, subcategory, round(least(1.0, 0.5 + 0.1 * n), 2)::DOUBLE AS confidence FROM k UNION ALL SELECT id, 'other', NULL, 0.3 FROM t WHERE id NOT IN (SELECT id FROM k)"


def _sub(name: str) -> str:
    parts = [[w for w in p.split() if len(w) > 2] for p in name.lower().replace("(", "").replace(")", "").split("/")]
    return "(" + " OR ".join("(" + (" AND ".join("contains(t, " + _re(w) + ")" for w in p) or "TRUE") + ")" for p in parts) + ")"


def _component(name: str) -> str:
    n, w = f"regexp_extract(coalesce(raw_text, ''), {_re(X.COMPONENTS[name])}, 1)", f"lower(regexp_extract(coalesce(raw_text, ''), {_re(X.COMPONENTS[name])}, 2))"
    return f"CAST(TRY_CAST(regexp_replace(replace({n}, ',', ''), '\\.$', '') AS DECIMAL(20,4)) * CASE {w} WHEN 'thousand' THEN 1000 WHEN 'million' THEN 1000000 WHEN 'billion' THEN 1000000000 ELSE 1 END AS DOUBLE) AS {name}"


def _clean() -> str:
    n = "trim(coalesce(raw_name, ''))"
    n = f"regexp_replace(trim(regexp_replace({n}, {_re('(?i)' + fixed.TRAILING)}, '')), '[,.]+$', '')"
    n = f"trim(regexp_replace({n}, {_re('(?i)' + fixed.LEADING)}, ''))"
    n = f"regexp_replace({n}, '^(?i:The|A|An)\\s+', '')"
    for _ in range(3):
        n = f"regexp_replace(trim(regexp_replace({n}, {_re('(?i)' + fixed.SUFFIX)}, '')), '[,.]+$', '')"
    n = f"trim(regexp_replace({n}, '\\s+', ' ', 'g'))"
    return f"SELECT id, CASE WHEN n = upper(n) OR n = lower(n) THEN array_to_string(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(n[i - 1], '\\p{{L}}') THEN upper(n[i]) ELSE lower(n[i]) END), '') ELSE n END AS cleaned FROM (SELECT id, {n} AS n FROM defendants)"


def _variants() -> str:
    a = "CAST(total_amount AS DOUBLE)"
    b, m1, k, whole = f"printf('$%.1fB', {a} / 1e9)", f"printf('$%.1fM', {a} / 1e6)", f"printf('$%.0fK', {a} / 1e3)", f"format('${{:,.0f}}', {a})"
    return (
        f"SELECT action_id, CASE WHEN {a} >= 1e9 THEN printf('$%.2fB', {a} / 1e9) WHEN {a} >= 1e6 THEN {m1} WHEN {a} >= 1e3 THEN {whole} ELSE printf('$%.2f', {a}) END AS report, CASE WHEN {a} >= 1e9 THEN {b} WHEN {a} >= 1e6 THEN {m1} ELSE {whole} END AS dashboard,"
        f" CASE WHEN {a} >= 1e6 THEN {m1} WHEN {a} > 0 THEN {whole} ELSE '—' END AS search, CASE WHEN {a} = 0 THEN '' WHEN {a} >= 1e9 THEN {b} WHEN {a} >= 1e6 THEN {m1} WHEN {a} >= 1e3 THEN {k} ELSE {whole} END AS sample,"
        f" CASE WHEN {a} = 0 THEN '' WHEN {a} = floor({a}) THEN printf('%.0f', {a}) ELSE printf('%.2f', {a}) END AS clean FROM monetary_terms"
    )


ORACLES = {
    "i09_dollar_amounts": _AMOUNTS + "SELECT a.id, CAST(count(v.amount) AS BIGINT) AS n, CAST(coalesce(sum(v.amount), 0) AS DOUBLE) AS total FROM enforcement_actions a LEFT JOIN v ON v.id = a.id GROUP BY a.id",
    "i13_components": "SELECT id, " + ", ".join(_component(c) for c in X.COMPONENTS) + " FROM enforcement_actions",
    "i16_statutes": _statutes(),
    "i22_summary": "SELECT id, coalesce(array_to_string(list_transform(regexp_extract_all(coalesce(raw_text, ''), '(?s).{20,}?[.!?]')[1:3], lambda x: trim(x)), ' '), '') AS summary FROM enforcement_actions",
    "j01_verdict": _verdict(),
    "j07_categories": _categories(),
    "k01_clean_names": _clean(),
    "h04_amount_variants": _variants(),
    "h23_years": "SELECT CASE WHEN y = 2026 THEN '2026 (YTD)' ELSE CAST(y AS VARCHAR) END AS year, n AS actions FROM (SELECT year(date_announced) AS y, count(*) AS n FROM enforcement_actions GROUP BY 1)",
    "m07_reset": "SELECT 'enforcement_actions' AS name, count(*) AS n, count_if(coalesce(raw_text, '') <> '' OR quality_score = 0) AS waiting FROM enforcement_actions UNION ALL SELECT unnest(['defendants', 'action_defendants', 'violation_categories', 'monetary_terms']), 0, 0",
    "m10_merged": "SELECT id, CASE WHEN created_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' THEN headline || ' (updated)' ELSE headline END AS headline FROM enforcement_actions",
    "o05_search": """
SELECT id, state, date_announced, headline FROM enforcement_actions a WHERE state = 'CA' AND date_announced BETWEEN DATE '2018-01-01' AND DATE '2026-12-31' AND headline ILIKE '%t%'
  AND id IN (SELECT action_id FROM violation_categories WHERE category = 'consumer_protection') AND id IN (SELECT action_id FROM monetary_terms WHERE total_amount >= 1000)
  AND id IN (SELECT x.action_id FROM action_defendants x JOIN defendants d ON d.id = x.defendant_id WHERE d.canonical_name ILIKE '%a%' OR d.raw_name ILIKE '%a%')""",
    "o06_nested_action": """
SELECT a.id, coalesce(d.n, 0) AS defendants, coalesce(c.n, 0) AS categories, CAST(m.total_amount AS DOUBLE) AS total_amount, length(a.raw_text) AS chars FROM enforcement_actions a
LEFT JOIN (SELECT x.action_id, count(*) AS n FROM action_defendants x JOIN defendants y ON y.id = x.defendant_id GROUP BY 1) d ON d.action_id = a.id LEFT JOIN (SELECT action_id, count(*) AS n FROM violation_categories GROUP BY 1) c ON c.action_id = a.id LEFT JOIN monetary_terms m ON m.action_id = a.id""",
    "o13_quarters_of": "SELECT concat(year(date_announced), '-Q', quarter(date_announced)) AS period, count(*) AS actions FROM enforcement_actions WHERE state = 'TX' AND id IN (SELECT action_id FROM violation_categories WHERE category = 'healthcare') GROUP BY 1",
    "i10_largest_amount": _AMOUNTS + "SELECT a.id, CAST(max(v.amount) AS DOUBLE) AS largest FROM enforcement_actions a LEFT JOIN v ON v.id = a.id GROUP BY a.id",
    "j02_patterns": f"SELECT id, regexp_matches({_TEXT}, {_re(X.HAS_DOLLAR)}) AS dollar, regexp_matches({_TEXT}, {_re(X.HAS_STATUTE)}) AS statute, regexp_matches({_TEXT}, {_re(X.HAS_COURT)}) AS court, regexp_matches({_TEXT}, {_re(X.HAS_DEFENDANT)}) AS defendant FROM enforcement_actions",
    "j04_action_type": f"SELECT id, kind, CASE WHEN kind IN ('settlement', 'consent_decree', 'judgment') THEN 'settled' WHEN kind = 'lawsuit_filed' THEN 'pending' WHEN kind = 'injunction' THEN 'ongoing' ELSE 'announced' END AS status FROM (SELECT id, {_kind()} AS kind FROM enforcement_actions)",
    "j06_multistate": f"SELECT id, regexp_matches(coalesce(headline, '') || ' ' || substr(coalesce(raw_text, ''), 1, 2000), {_re(X.MULTISTATE)}) AS multistate FROM enforcement_actions",
    "l05_labels": """
WITH RECURSIVE e AS (SELECT action_id_a AS a, action_id_b AS b FROM dedup_matches WHERE match_type = 'multistate' AND action_id_a <> '' AND action_id_b <> '' AND action_id_a <> action_id_b),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS x, b AS y FROM d UNION SELECT r.x, d.b FROM r JOIN d ON d.a = r.y)
SELECT x AS id, min(least(x, y)) AS label FROM r GROUP BY x""",
    "l10_headline_first": "SELECT headline, arg_min(id, (date_announced, id)) AS first_id, count(*) AS n FROM enforcement_actions WHERE headline IS NOT NULL GROUP BY headline",
    "m01_new_rows": "SELECT source_url, id FROM enforcement_actions WHERE created_at >= TIMESTAMPTZ '2023-01-01 00:00:00+00'",
    "x02_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "x03_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""",
}
