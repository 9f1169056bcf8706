"""The star schema: typed tables, loading, validation, schema comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


#: Columns of every table, in order; children hold ``action_id``.
DDL = {
    "enforcement_actions": "id STRING, state STRING, date_announced DATE, date_filed DATE, date_resolved DATE, action_type STRING, status STRING, headline STRING, summary STRING, source_url STRING, is_multistate BOOLEAN, is_federal_litigation BOOLEAN, multistate_action_id STRING, quality_score DOUBLE, extraction_method STRING, raw_text STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "defendants": "id STRING, raw_name STRING, canonical_name STRING, entity_type STRING, industry STRING, parent_company STRING, sec_cik STRING",
    "action_defendants": "action_id STRING, defendant_id STRING, role STRING",
    "violation_categories": "action_id STRING, category STRING, subcategory STRING, confidence DOUBLE",
    "monetary_terms": "action_id STRING, total_amount DECIMAL(18,2), civil_penalty DECIMAL(18,2), consumer_restitution DECIMAL(18,2), fees_and_costs DECIMAL(18,2), other_monetary DECIMAL(18,2), amount_is_estimated BOOLEAN",
    "statutes_cited": "action_id STRING, statute_raw STRING, statute_name STRING, is_state_statute BOOLEAN, is_federal_statute BOOLEAN",
    "multistate_actions": "id STRING, name STRING, lead_state STRING, participating_states ARRAY<STRING>, total_settlement DECIMAL(18,2)",
    "scrape_runs": "id STRING, state STRING, started_at TIMESTAMP, completed_at TIMESTAMP, press_releases_found INT, actions_extracted INT, errors INT",
    "state_sites": "state STRING, state_name STRING, office STRING, host STRING",
    "dedup_matches": "action_id_a STRING, action_id_b STRING, match_type STRING, confidence DOUBLE, reason STRING",
}
#: Values that enumerated columns may hold.
DOMAINS = {
    ("enforcement_actions", "action_type"): ("settlement", "lawsuit_filed", "judgment", "consent_decree", "injunction", "assurance_of_discontinuance", "other"),
    ("enforcement_actions", "status"): ("announced", "pending", "settled", "ongoing", "dismissed"),
    ("enforcement_actions", "extraction_method"): ("rules", "llm", "hybrid"),
    ("action_defendants", "role"): ("primary", "co-defendant", "subsidiary"),
}
KEYS = {"enforcement_actions": ("id", "source_url"), "defendants": ("id",), "monetary_terms": ("action_id",), "scrape_runs": ("id",), "multistate_actions": ("id",)}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table; only the columns a plan uses are read."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns in schema order and type; missing ones are added as nulls, unknown ones dropped (additive migration)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(table).fields])


def schema_diff(df: DataFrame, table: str) -> list[str]:
    """What ``df`` lacks against the schema."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema(table).fields:
        if f.name not in have:
            out.append(f"Missing column: {table}.{f.name}")
        elif have[f.name] != f.dataType:
            out.append(f"Type of {table}.{f.name}: {have[f.name].simpleString()}, expected {f.dataType.simpleString()}")
    return out


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, rows): how many rows break each rule of the table, in one pass for all row rules."""
    rules = {}
    if table == "enforcement_actions":
        rules = {"headline is empty": F.coalesce(F.col("headline"), F.lit("")) == "", "source_url is empty": F.coalesce(F.col("source_url"), F.lit("")) == "", "state isn't two characters": F.coalesce(F.length("state"), F.lit(0)) != 2, "quality_score outside [0, 1]": ~F.col("quality_score").between(0, 1)}
    if table == "violation_categories":
        rules = {"confidence outside [0, 1]": ~F.col("confidence").between(0, 1)}
    if table == "defendants":
        rules = {"raw_name is empty": F.coalesce(F.col("raw_name"), F.lit("")) == ""}
    for (t, c), values in DOMAINS.items():
        if t == table and c in df.columns:
            rules[f"{c} outside its domain"] = ~F.col(c).isin(*values)
    spark = df.sparkSession
    out = spark.createDataFrame([], "rule string, rows bigint")
    if rules:
        one = df.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
        out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in rules])).alias("r")).select("r.*")
    for k in KEYS.get(table, ()):
        dup = df.groupBy(k).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit(f"{k} isn't unique").alias("rule"), "rows")
        out = out.unionByName(dup)
    return out
