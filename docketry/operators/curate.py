"""A small sample of records chosen for diversity, greedily.

Every round takes the record with the highest score; a score is what the record
is worth in itself plus what it adds to the counts so far.  The choice is
sequential by nature, but it only sees a record's *profile* (state, categories,
type, amount bucket, multistate, recency) and its own worth: of a profile the
best record is taken first.  So Spark reduces the table to the best records of each
profile, twice ``rounds`` (a bounded number: profiles are combinations of a few
values), and the rounds run over those.  Weights and targets are parameters.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X

#: Counts below which one more of a kind is worth so much, in order: (below, worth).
STATE = [(1, 8), (2, 7), (3, 6), (4, 5), (5, 4), (8, 2), (11, 0), (10**9, -15)]
CATEGORY = [(2, 4.0), (5, 2.0), (8, 0.5)]
TYPE = {"consent_decree": [(2, 5), (4, 2)], "assurance_of_discontinuance": [(2, 5), (4, 2)], "injunction": [(3, 4), (5, 1)], None: [(10, 1)]}
BUCKET = {"large": (10, 3), "mid": (15, 2), "small": (8, 2), "none": (12, 1)}
MULTISTATE = (12, 3)


def clean_party(name):
    """A party's name without what follows " by X" and " of all counts"; null where it is too short, too long or a sentence."""
    n = F.trim(name)
    ok = F.length(n).between(3, 70) & ~((n == F.lower(n)) & (F.length(n) > 15)) & (F.length(n) - F.length(F.replace(n, F.lit(" "))) <= 6)
    cut = F.trim(F.regexp_replace(F.regexp_replace(n, r"\s+by\s+[A-Z].*$", ""), r"\s+of all counts.*$", ""))
    return F.when(ok & (F.length(cut) >= 3), cut)


def headline_short(headline):
    """Headline without a leading "Press Release", at most 150 characters, cut at a blank."""
    h = F.regexp_replace(F.coalesce(headline, F.lit("")), r"^Press Release\s*", "")
    cut = F.substring(h, 1, 147)
    return F.when(F.length(h) > 150, F.concat(F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut), F.lit("..."))).otherwise(h)


def records(actions: DataFrame, links: DataFrame, names: DataFrame, categories: DataFrame, money: DataFrame, least_quality: float = 0.5) -> DataFrame:
    """One row per action of the least quality with a clean party: what the sample shows and what the choice needs."""
    d = links.select("action_id", "defendant_id").distinct().join(names.select(F.col("id").alias("defendant_id"), "canonical_name", "industry"), "defendant_id")
    # (a name is one party, also with a comma in it)
    d = d.groupBy("action_id").agg(F.array_sort(F.collect_set(clean_party(F.col("canonical_name")))).alias("parties"), F.min("industry").alias("industry"))
    c = categories.groupBy("action_id").agg(F.collect_set("category").alias("cats"))
    a = actions.where(F.col("quality_score") >= least_quality)
    j = a.join(d.withColumnRenamed("action_id", "id"), "id").join(c.withColumnRenamed("action_id", "id"), "id", "left").join(money.select(F.col("action_id").alias("id"), "total_amount"), "id", "left").where(F.size("parties") > 0)
    amount = F.col("total_amount")
    bucket = F.when(amount > 100_000_000, "large").when(amount >= 1_000_000, "mid").when(amount > 0, "small").otherwise("none")
    day = F.col("date_announced")
    recent = F.when(day >= "2024-01-01", 2).when(day >= "2022-01-01", 1).when(day >= "2018-01-01", 0).otherwise(-3)
    short = headline_short(F.col("headline"))
    return j.where(~F.coalesce((amount > 0) & (amount < 500), F.lit(False))).select(
        "id", "state", day.alias("date"), "parties", "industry", short.alias("headline"), X.first_categories(F.coalesce("cats", F.expr("CAST(array() AS array<string>)"))).alias("categories"), "action_type", X.amount_label(amount, "sample").alias("settlement_amount"),
        F.coalesce("is_multistate", F.lit(False)).alias("is_multistate"), "source_url", bucket.alias("bucket"), (F.col("quality_score") * 2 + recent).alias("worth"), F.trim(F.lower(F.substring(short, 1, 50))).alias("headline_key"),
    )


def choose(rows: DataFrame, target_states: tuple[str, ...], known_parties: tuple[str, ...] = (), rounds: int = 65) -> DataFrame:
    """The chosen rows of ``records`` with their rank; ties go to the smaller id.  Equal headlines (50 characters) count once."""
    party = F.lower(F.array_join("parties", ","))
    bonus = F.lit(0)
    for p in known_parties:
        bonus = F.when(F.contains(party, F.lit(p.lower())), 5).otherwise(bonus)
    r = rows.withColumn("worth", F.col("worth") + bonus)
    # one row of a headline within a profile can be chosen, and the headlines of at most ``rounds`` others are taken by other profiles
    profile = ["state", "categories", "action_type", "bucket", "is_multistate"]
    best = r.withColumn("_h", F.row_number().over(Window.partitionBy(*profile, "headline_key").orderBy(F.desc("worth"), "id"))).where("_h = 1")
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(*profile).orderBy(F.desc("worth"), "id"))).where(F.col("_r") <= 2 * rounds).drop("_h", "_r")
    pool = sorted((x.asDict() for x in best.select("id", "worth", "headline_key", *profile).collect()), key=lambda x: x["id"])
    count, keys, chosen = Counter(), set(), []

    def step(table, n):
        return next((w for below, w in table if n < below), 0)

    def score(x):
        s = x["worth"] + (step(STATE, count["s", x["state"]]) if x["state"] in target_states else -5)
        s += sum(step(CATEGORY, count["c", c]) for c in x["categories"])
        s += step(TYPE.get(x["action_type"], TYPE[None]), count["t", x["action_type"]])
        below, w = BUCKET[x["bucket"]]
        s += w if count["b", x["bucket"]] < below else 0
        return s + (MULTISTATE[1] if x["is_multistate"] and count["m"] < MULTISTATE[0] else 0)

    while pool and len(chosen) < rounds:
        x = max(pool, key=score)  # the first of equal ones
        chosen.append((x["id"], len(chosen) + 1))
        keys.add(x["headline_key"])
        count.update([("s", x["state"]), ("t", x["action_type"]), ("b", x["bucket"]), *(("c", c) for c in x["categories"]), *(["m"] if x["is_multistate"] else [])])
        pool = [y for y in pool if y["headline_key"] not in keys]
    spark = rows.sparkSession
    return rows.join(F.broadcast(spark.createDataFrame(chosen, "id string, rank int")), "id")


def sample_table(chosen: DataFrame) -> DataFrame:
    """The sample's ten columns (and the rank), by state and date."""
    return chosen.select("state", F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), F.array_join(F.slice("parties", 1, 3), "; ").alias("defendant"), F.coalesce("industry", F.lit("")).alias("industry"), "headline", F.array_join("categories", "; ").alias("violation_category"), F.coalesce("action_type", F.lit("")).alias("action_type"), "settlement_amount", F.initcap(F.col("is_multistate").cast("string")).alias("is_multistate"), F.coalesce("source_url", F.lit("")).alias("source_url"), "rank").orderBy("state", "date")
