"""Fuzzy matching: name scores, duplicate pairs, clusters and greedy bands."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import config
from docketry.functions import fixed
from docketry.functions.text import bind
from docketry.operators.graph import checkpointed, labels

WINDOW_DAYS, MULTISTATE_DAYS = 30, 730
LEAST_NAME, LEAST_CONFIDENCE, LEAST_HEADLINE, SIMILAR_AMOUNT = 80, 0.5, 70, 0.9
#: Names of one length that are compared in one group.
NAME_TILE = 1000
_NOT_WORD = re.compile(r"[^\w]+")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def sorted_tokens(name: str | None) -> str:
    return " ".join(sorted(_NOT_WORD.sub(" ", (name or "").lower()).split()))


def token_sort(a: str | None, b: str | None) -> int:
    """Similarity 0 to 100 of two names by their sorted words: 200 * LCS / (lengths), rounded; 0 if either is empty."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    if not x or not y:
        return 0
    return 100 if x == y else round(200 * _lcs(x, y) / (len(x) + len(y)))


@F.pandas_udf(T.IntegerType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sorted_all(names: pd.Series) -> pd.Series:
    return pd.Series([[sorted_tokens(x) for x in ([] if v is None else v)] for v in names], dtype=object)


@F.pandas_udf(T.StringType())
def _sorted_one(names: pd.Series) -> pd.Series:
    return pd.Series([sorted_tokens(x) for x in names], dtype=object)


def _letters(names: list[str]) -> np.ndarray:
    """Number of letters of each name by the last five bits of their code."""
    out = np.zeros((len(names), 32), np.int16)
    for i, n in enumerate(names):
        for c in n:
            out[i, ord(c) & 31] += 1
    return out


def similar_names(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(left_key, right_key, score): all pairs with a token_sort of at least ``least``, equal keys included.

    left, right: (key), distinct sorted words without the empty one.  Exact:
    tiles of names of one length meet those whose length allows the score; in a
    pair of tiles the letters that two names have in common bound their longest
    common subsequence, and what passes is scored.
    """

    def tiles(df: DataFrame, side: str) -> DataFrame:
        d = df.select("key", F.length("key").alias("n"))
        size = d.groupBy("n").agg(F.ceil(F.count("*") / NAME_TILE).cast("int").alias("tiles"))
        t = d.join(size, "n").groupBy("n", F.pmod(F.xxhash64("key"), F.col("tiles")).alias("tile")).agg(F.collect_list("key").alias(side))
        return t.select(F.col("n").alias("n_" + side), F.col("tile").alias("tile_" + side), side)

    def compare(batches):
        for b in batches:
            for xs, ys in zip(b.column("l").to_pylist(), b.column("r").to_pylist()):
                u, v, s = [], [], []
                p, q = _letters(xs), _letters(ys)
                need = (least - 0.5) * (p.sum(1)[:, None] + q.sum(1)[None, :])
                common = np.zeros(need.shape, np.int16)
                for c in range(32):
                    common += np.minimum(p[:, c, None], q[None, :, c])
                for i, j in zip(*np.nonzero(200 * common.astype(np.int64) >= need)):
                    x, y = xs[i], ys[j]
                    score = 100 if x == y else round(200 * _lcs(x, y) / (len(x) + len(y)))
                    if score >= least:
                        u.append(x)
                        v.append(y)
                        s.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(s, pa.int32())], names=["left_key", "right_key", "score"])

    # lengths of the right side that allow the score: 200 * shorter >= limit * (sum of both)
    limit = least - 0.5
    low, high = F.ceil(F.col("n_l") * limit / (200 - limit) - 1e-9), F.floor(F.col("n_l") * (200 - limit) / limit + 1e-9)
    met = tiles(left, "l").withColumn("n_r", F.explode(F.sequence(low.cast("int"), high.cast("int")))).join(tiles(right, "r"), "n_r")
    spread = met.repartition(F.col("n_l"), F.col("tile_l"), F.col("n_r"), F.col("tile_r"))
    return spread.select("l", "r").mapInArrow(compare, "left_key string, right_key string, score int")


def candidates(actions: DataFrame, links: DataFrame, names: DataFrame, money: DataFrame) -> DataFrame:
    """One row per action that has defendants: (id, state, date, defendants, amount, headline, multistate)."""
    d = links.join(names.select(F.col("id").alias("defendant_id"), F.coalesce(F.expr("nullif(canonical_name, '')"), "raw_name").alias("name")), "defendant_id").groupBy(F.col("action_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("defendants"))
    return actions.select("id", "state", F.col("date_announced").alias("date"), "headline", F.coalesce("is_multistate", F.lit(False)).alias("multistate")).join(d, "id").join(money.select(F.col("action_id").alias("id"), F.col("total_amount").alias("amount")), "id", "left")


def duplicate_pairs(cand: DataFrame) -> DataFrame:
    """(action_id_a, action_id_b, match_type, confidence, reason): pairs that may be the same matter, the smaller id first.

    Names are reduced to classes of equal sorted words and compared class by
    class (``similar_names``, exact); actions then meet by equi-join on a pair
    of classes and a stretch of dates.  The wide window holds only for pairs of
    multistate actions, so all others meet within stretches of the narrow one.
    """
    named = cand.select("id", "state", "date", "multistate", _sorted_all("defendants").alias("keys")).select("id", "state", "date", "multistate", F.explode(F.array_distinct("keys")).alias("key")).where("key <> '' AND date IS NOT NULL")
    classes = named.select("key").distinct()
    like = similar_names(classes, classes, LEAST_NAME)

    def meet(rows: DataFrame, stretch: int) -> DataFrame:
        k = rows.withColumn("s", F.floor(F.datediff("date", F.lit("1970-01-01")) / stretch))
        left = k.select(*[F.col(c).alias("a_" + c) for c in rows.columns], "s").join(like, F.col("a_key") == F.col("left_key"))
        right = k.select(*[F.col(c).alias("b_" + c) for c in rows.columns], F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("t"))
        days = F.abs(F.datediff("a_date", "b_date"))
        return left.join(right, (F.col("right_key") == F.col("b_key")) & (F.col("s") == F.col("t"))).where("a_id < b_id").withColumn("days", days)

    wide = meet(named.where("multistate"), MULTISTATE_DAYS).where((F.col("days") > WINDOW_DAYS) & (F.col("days") <= MULTISTATE_DAYS) & (F.col("a_state") != F.col("b_state")))
    met = meet(named, WINDOW_DAYS).where(F.col("days") <= WINDOW_DAYS).unionByName(wide).groupBy("a_id", "b_id").agg(F.max("score").alias("score"))
    p = met.join(cand.select(*[F.col(c).alias("a_" + c) for c in cand.columns if c != "defendants"]), "a_id").join(cand.select(*[F.col(c).alias("b_" + c) for c in cand.columns if c != "defendants"]), "b_id")
    p = p.withColumn("days", F.abs(F.datediff("a_date", "b_date"))).withColumn("window", F.when(F.col("a_multistate") & F.col("b_multistate") & (F.col("a_state") != F.col("b_state")), MULTISTATE_DAYS).otherwise(WINDOW_DAYS))
    p = p.withColumn("hl", token_sort_ratio("a_headline", "b_headline"))
    both = (F.coalesce("a_amount", F.lit(0)) > 0) & (F.coalesce("b_amount", F.lit(0)) > 0)
    exact = both & (F.col("a_amount") == F.col("b_amount"))
    similar = both & ~exact & (F.least("a_amount", "b_amount") / F.greatest("a_amount", "b_amount") >= SIMILAR_AMOUNT)
    conf = 0.4 * F.col("score") / 100 + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("days") / F.col("window")) + F.when(exact, 0.3).when(similar, 0.15).otherwise(0.0) + F.when(F.col("hl") > LEAST_HEADLINE, 0.1 * F.col("hl") / 100).otherwise(0.0)
    reason = F.concat_ws("; ", F.format_string("defendants=%d%%", "score"), F.format_string("date_diff=%dd", "days"), F.when(exact, "exact_amount_match").when(similar, "similar_amount"), F.when(F.col("hl") > LEAST_HEADLINE, F.format_string("headline=%d%%", "hl")))
    return p.select(F.col("a_id").alias("action_id_a"), F.col("b_id").alias("action_id_b"), F.when(F.col("a_state") != F.col("b_state"), "multistate").otherwise("temporal").alias("match_type"), F.round(F.least(F.lit(1.0), conf), 3).alias("confidence"), reason.alias("reason")).where(F.col("confidence") >= LEAST_CONFIDENCE)


def clusters(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """Groups of multistate pairs: (cluster_id, members, states, lead_state, lead_action, name, total_amount)."""
    g = labels(pairs.where("match_type = 'multistate'"), "action_id_a", "action_id_b")
    m = g.join(cand, "id")
    first = F.min_by(F.struct("id", "state", "headline", "defendants"), F.struct("date", "id"))
    out = m.groupBy("label").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("state")).alias("states"), F.max(F.when(F.col("amount") != 0, F.col("amount"))).alias("total_amount"), first.alias("first"))
    name = F.coalesce(F.expr("nullif(array_join(slice(first.defendants, 1, 2), ', '), '')"), F.substring("first.headline", 1, 80))
    return out.where(F.size("ids") > 1).select(F.sha2(F.array_join("ids", ","), 256).alias("cluster_id"), F.size("ids").alias("members"), F.array_join("states", ",").alias("states"), F.col("first.state").alias("lead_state"), F.col("first.id").alias("lead_action"), name.alias("name"), "total_amount")


def link_back(actions: DataFrame, links: DataFrame, names: DataFrame, money: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(multistate_actions rows, actions with their multistate_action_id) from the duplicate pairs among multistate actions."""
    multi = candidates(actions.where("is_multistate"), links, names, money)
    pairs = duplicate_pairs(multi).where("match_type = 'multistate'")
    ids = labels(pairs, "action_id_a", "action_id_b")
    cluster = ids.groupBy("label").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("id")), ","), 256).alias("cluster_id"))
    of = ids.join(cluster, "label").select("id", "cluster_id")
    c = clusters(pairs, multi)
    rows = c.select(F.col("cluster_id").alias("id"), "name", "lead_state", F.split("states", ",").alias("participating_states"), F.col("total_amount").alias("total_settlement"))
    kept = [x for x in actions.columns if x != "multistate_action_id"]
    old = F.col("multistate_action_id") if "multistate_action_id" in actions.columns else F.lit(None).cast("string")
    linked = actions.withColumn("_old", old).join(of, "id", "left").select(*kept, F.coalesce("cluster_id", "_old").alias("multistate_action_id"))
    return rows, linked


def bands(rows: DataFrame, top: int = 10, tolerance: float = 0.01, days: int = 365, multistate: tuple[float, int] | None = None, inclusive: bool = False) -> DataFrame:
    """Greedy settlement groups: the largest unclaimed amount seeds a group and claims what lies within ``tolerance`` and ``days`` of it.

    multistate: another (tolerance, days) for seeds that are multistate.
    inclusive: the band reaches from (1 - tolerance) to (1 + tolerance) times
    the seed, bounds included; else an amount has to differ by less than the
    tolerance of the larger of seed and 1.  Undated rows join only their own
    seed (inclusive) or groups of any date that allows 9,999 days.
    rows: (id, state, date, amount, headline, multistate).

    Seeds go down in amount, so one group is one question to the table: the
    largest amount below which nothing is claimed yet.  What a group claims is
    read as counts by state; claimed rows are told by the list of the seeds so
    far, ``top`` at most, and never collected.
    """
    spark = rows.sparkSession
    want = rows.where("amount > 0").select("id", "state", "date", "amount", "headline", F.coalesce("multistate", F.lit(False)).alias("multistate"))

    def claims(seed: dict) -> Column:
        tol, most = multistate if multistate and seed["multistate"] else (tolerance, days)
        a, amount = F.col("amount").cast("double"), float(seed["amount"])
        near = a.between(amount * (1 - tol), amount * (1 + tol)) if inclusive else F.abs(a - amount) < tol * max(amount, 1.0)
        gap = F.abs(F.datediff("date", F.lit(seed["date"]))) if seed["date"] else F.lit(None).cast("int")
        return (near & F.coalesce(gap <= most, F.lit(False if inclusive else most >= 9999))) | (F.col("id") == seed["id"])

    found: list[tuple] = []
    left = checkpointed(want)  # few columns of the rows with an amount; read twice a group
    while len(found) < top:
        # as a group is asked for, only rows that no seed has claimed are in question
        seed = left.orderBy(F.desc("amount"), F.asc("date"), "id").limit(1).collect()
        if not seed:
            break
        seed = seed[0].asDict()
        mine = claims(seed)
        by_state = left.where(mine).groupBy("state").agg(F.count("*").alias("n"), F.bool_or("multistate").alias("m")).collect()
        states = sorted(r["state"] for r in by_state if r["state"] is not None)
        flag = any(r["m"] for r in by_state) if inclusive else bool(seed["multistate"])
        found.append((len(found) + 1, seed["id"], seed["headline"], seed["date"], seed["amount"], ",".join(states), sum(r["n"] for r in by_state), len(by_state) > 1 or flag))
        left = left.where(~mine)
    return spark.createDataFrame(found, "rank int, seed string, headline string, date date, amount decimal(18,2), states string, members bigint, multistate boolean")


# --- entity resolution ------------------------------------------------------
def clean_name(raw: Column) -> Column:
    """Name without trailing sentence fragments, leading descriptions and article, and (up to three) legal forms; in title case if it was all upper or lower."""
    n = F.trim(F.coalesce(raw, F.lit("")))
    n = F.regexp_replace(F.trim(F.regexp_replace(n, "(?i)" + fixed.TRAILING, "")), r"[,.]+$", "")
    n = F.trim(F.regexp_replace(n, "(?i)" + fixed.LEADING, ""))
    n = F.regexp_replace(n, r"^(?i:The|A|An)\s+", "")
    for _ in range(3):
        n = F.regexp_replace(F.trim(F.regexp_replace(n, "(?i)" + fixed.SUFFIX, "")), r"[,.]+$", "")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))

    def cased(n: Column) -> Column:
        # every letter after something else is a capital, as in N/A and O'Neil
        titled = F.array_join(F.transform(F.split(F.lower(n), r"(?<=[^\p{L}])"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")
        return F.when((n == F.upper(n)) | (n == F.lower(n)), titled).otherwise(n)

    return bind(n, cased)


def is_name(name: Column, folder: str | None = None) -> Column:
    """Whether a cleaned name may be canonical: two characters or more, no stop word, not blocked, no fragment, no number."""
    exact, patterns = config.blocklist(folder)
    low = F.lower(F.trim(name))
    bad = low.isin(*sorted({*fixed.NO_NAMES, *exact})) | name.rlike(fixed.any_of([*fixed.NO_NAME_PATTERNS, *patterns])) | low.rlike(r"^\d+$")
    return (F.length(name) >= 2) & ((F.length(name) >= 3) | name.rlike("^[A-Z0-9]{2,3}$")) & ~bad


def resolve(names: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, metadata: DataFrame | None = None, accept: int = 85, review: int = 70, folder: str | None = None) -> DataFrame:
    """(raw_name, cleaned, canonical_name, confidence, how, candidate, score, entity_type, industry, sec_cik) of each distinct raw name.

    canonical: (name), a table of its own; aliases: (alias, name); metadata:
    (name, entity_type, industry, sec_cik).  First an exact match of the
    cleaned or the raw name (confidence 1), then the best token_sort among all
    canonical names of a length within [0.4, 2.5] (from ``accept``: its score;
    from ``review``: to be looked at, the name stays and candidate and score
    say what it might be), else a new name (0.5); invalid names give an empty
    one (0).  The comparison is exact (``similar_names``); ties go to the
    first name.
    """
    raw = names.select("raw_name").where("raw_name IS NOT NULL").distinct().withColumn("cleaned", clean_name(F.col("raw_name")))
    raw = checkpointed(raw.withColumn("ok", is_name(F.col("cleaned"), folder)))  # distinct names, read four times
    known = canonical.select(F.lower("name").alias("key"), "name")
    if aliases is not None:
        known = known.union(aliases.select(F.lower("alias"), "name"))
    known = known.groupBy("key").agg(F.min("name").alias("name"))
    hit = raw.where("ok").withColumn("key", F.explode(F.array_distinct(F.array(F.lower("cleaned"), F.lower(F.trim("raw_name")))))).join(known, "key").groupBy("raw_name").agg(F.min_by("name", F.when(F.col("key") == F.lower("cleaned"), 0).otherwise(1)).alias("exact"))
    rest = raw.where("ok").join(hit, "raw_name", "left_anti").where(F.length("cleaned") >= 4).select("raw_name", "cleaned", _sorted_one("cleaned").alias("left_key"))
    targets = canonical.union(aliases.select("name")) if aliases is not None else canonical
    targets = targets.distinct().where(F.length("name") >= 4).select("name", _sorted_one("name").alias("right_key"))
    like = similar_names(rest.select(F.col("left_key").alias("key")).where("key <> ''").distinct(), targets.select(F.col("right_key").alias("key")).where("key <> ''").distinct(), review)
    met = rest.join(like, "left_key").join(targets, "right_key").where((F.length("cleaned") / F.length("name")).between(0.4, 2.5))
    best = met.groupBy("raw_name").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name").alias("name"))).alias("b")).select("raw_name", F.col("b.name").alias("candidate"), (-F.col("b.s")).alias("score"))
    out = raw.join(hit, "raw_name", "left").join(best, "raw_name", "left")
    how = F.when(~F.col("ok"), "invalid").when(F.col("exact").isNotNull(), "exact").when(F.col("score") >= accept, "fuzzy").when(F.col("score") >= review, "review").otherwise("new")
    out = out.withColumn("how", how).select(
        "raw_name", "cleaned", F.when(F.col("how") == "exact", F.col("exact")).when(F.col("how") == "fuzzy", F.col("candidate")).when(F.col("how") == "invalid", "").otherwise(F.col("cleaned")).alias("canonical_name"),
        F.when(F.col("how") == "exact", 1.0).when(F.col("how") == "fuzzy", F.round(F.col("score") / 100, 2)).when(F.col("how") == "invalid", 0.0).otherwise(0.5).alias("confidence"), "how", "candidate", "score",
    )
    if metadata is None:
        return out.select("*", F.lit("corporation").alias("entity_type"), F.lit(None).cast("string").alias("industry"), F.lit(None).cast("string").alias("sec_cik"))
    m = metadata.groupBy(F.col("name").alias("canonical_name")).agg(F.first("entity_type").alias("entity_type"), F.first("industry").alias("industry"), F.first("sec_cik").alias("sec_cik"))
    return out.join(m, "canonical_name", "left").select(*out.columns, F.coalesce("entity_type", F.lit("corporation")).alias("entity_type"), "industry", "sec_cik")


def resolved(defendants: DataFrame, found: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Defendants whose canonical name is empty get the resolved one; keep_empty leaves them where the result is empty, too."""
    f = found.select("raw_name", F.col("canonical_name").alias("_new"))
    new = F.when(F.coalesce("canonical_name", F.lit("")) == "", F.when(F.lit(keep_empty) & (F.coalesce("_new", F.lit("")) == ""), F.col("canonical_name")).otherwise(F.coalesce("_new", "canonical_name"))).otherwise(F.col("canonical_name"))
    return defendants.join(f, "raw_name", "left").select(*[new.alias(c) if c == "canonical_name" else F.col(c) for c in defendants.columns])
