"""The questions an interface asks, as functions with optional filters; results hold their children as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.tables import load

MOST_ROWS = 500


def nested(actions: DataFrame, spark: SparkSession, root: str, body: bool = False, statutes: DataFrame | None = None) -> DataFrame:
    """Each action with its defendants, categories and monetary terms (and body and laws) as structs.

    Children of no rows are empty arrays; defendants without a row of their own
    are left out; repeated links stay.
    """
    ids = actions.select(F.col("id").alias("action_id"))
    links = load(spark, root, "action_defendants").join(ids, "action_id", "left_semi").join(load(spark, root, "defendants").select(F.col("id").alias("defendant_id"), "raw_name", "canonical_name"), "defendant_id")
    # an action's children: as many as it has, few
    d = links.groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("raw_name", "canonical_name", "role"))).alias("defendants"))
    c = load(spark, root, "violation_categories").join(ids, "action_id", "left_semi").groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("category", "subcategory", "confidence"))).alias("categories"))
    part = lambda n: F.when(F.col(n) != 0, F.col(n).cast("double")).alias(n)
    m = load(spark, root, "monetary_terms").select("action_id", F.struct(F.col("total_amount").cast("double").alias("total_amount"), part("civil_penalty"), part("consumer_restitution"), part("fees_and_costs"), "amount_is_estimated").alias("monetary_terms"))
    plain = ["id", "state", "date_announced", "action_type", "status", "headline", "source_url", "is_multistate", "quality_score"]
    none = lambda n, t: F.coalesce(n, F.expr(f"CAST(array() AS {t})")).alias(n)
    out = [*plain, *(["summary"] if "summary" in actions.columns else []), none("defendants", dict(d.dtypes)["defendants"]), none("categories", dict(c.dtypes)["categories"]), "monetary_terms", *(["raw_text"] if body else [])]
    j = actions
    for child in (d, c, m):
        j = j.join(child.withColumnRenamed("action_id", "id"), "id", "left")
    if body and statutes is not None:
        s = statutes.groupBy(F.col("action_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("statute_raw", "statute_name", "is_state_statute", "is_federal_statute"))).alias("statutes_cited"))
        j = j.join(s, "id", "left")
        out.append(none("statutes_cited", dict(s.dtypes)["statutes_cited"]))
    return j.select(*out)


def filtered(spark: SparkSession, root: str, state: str | None = None, category: str | None = None, action_type: str | None = None, defendant: str | None = None, since: str | None = None, until: str | None = None, min_amount: float | None = None, q: str | None = None) -> DataFrame:
    """Actions that every given filter lets through; absent, empty and zero filters let all through, search texts are literal."""
    a = load(spark, root, "enforcement_actions")
    if state:
        a = a.where(F.col("state") == state.upper())
    if action_type:
        a = a.where(F.col("action_type") == action_type)
    if since:
        a = a.where(F.col("date_announced") >= F.lit(since).cast("date"))
    if until:
        a = a.where(F.col("date_announced") <= F.lit(until).cast("date"))
    if q:
        a = a.where(F.col("headline").ilike(f"%{X.like_escaped(q)}%"))
    semi = []
    if category:
        semi.append(load(spark, root, "violation_categories").where(F.col("category") == category).select("action_id"))
    if defendant:
        like = f"%{X.like_escaped(defendant)}%"
        d = load(spark, root, "defendants").where(F.col("canonical_name").ilike(like) | F.col("raw_name").ilike(like))
        semi.append(load(spark, root, "action_defendants").join(d.select(F.col("id").alias("defendant_id")), "defendant_id", "left_semi").select("action_id"))
    if min_amount:
        semi.append(load(spark, root, "monetary_terms").where(F.col("total_amount") >= F.lit(str(min_amount)).cast("decimal(18,2)")).select("action_id"))
    for s in semi:
        a = a.join(s.withColumnRenamed("action_id", "id"), "id", "left_semi")
    return a


def list_actions(spark: SparkSession, root: str, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page of the filtered actions, the latest first, ties by id."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_ROWS}, offset 0 or more")
    page = filtered(spark, root, **filters).orderBy(F.desc("date_announced"), "id").offset(offset).limit(limit)
    return nested(page, spark, root).orderBy(F.desc("date_announced"), "id")


def get_action(spark: SparkSession, root: str, action_id: str, statutes: DataFrame | None = None) -> DataFrame:
    """The action with its body, children and laws; no row where there is none."""
    return nested(load(spark, root, "enforcement_actions").where(F.col("id") == action_id), spark, root, True, statutes)


def timeline(spark: SparkSession, root: str, by: str = "month", state: str | None = None, category: str | None = None) -> DataFrame:
    """(period, actions) by month, quarter or year."""
    d = F.col("date_announced")
    period = {"month": F.date_format(d, "yyyy-MM"), "quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")), "year": F.year(d).cast("string")}[by]
    return filtered(spark, root, state=state, category=category).groupBy(period.alias("period")).agg(F.count("*").cast("bigint").alias("actions")).orderBy("period")
