"""Exports and incremental writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, name: str = "actions") -> None:
    """One JSON document {"count": n, name: [...]} in parts that are read one after the other: head, rows, tail.

    The rows stay distributed; a file of all of them is the parts' concatenation.
    """
    n = df.count()
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    spark = df.sparkSession
    numbered = rows.withColumn("value", F.concat(F.col("value"), F.lit(",")))
    last = spark.createDataFrame([("null]}",)], "value string")
    head = spark.createDataFrame([(f'{{"count": {n}, "{name}": [',)], "value string")
    head.unionByName(numbered).unionByName(last).write.mode("overwrite").text(path)


def read_document(text: str) -> dict:
    """The document of ``write_document``'s concatenated parts, without the closing null."""
    d = json.loads(text)
    return {k: v[:-1] if isinstance(v, list) else v for k, v in d.items()}


def write_pages(pages: DataFrame, path: str, url: str = "url", html: str = "html") -> None:
    """Raw pages under a name made of their address: every character outside words is ``_``, 80 characters at most; (name, url, html)."""
    name = F.substring(F.regexp_replace(F.regexp_replace(F.try_parse_url(F.col(url), F.lit("PATH")), r"^/|/$", ""), r"\W+", "_"), 1, 80)
    pages.select(name.alias("name"), F.col(url).alias("url"), F.col(html).alias("html")).write.mode("append").parquet(path)


def merged(stored: DataFrame, fresh: DataFrame, key: str = "source_url") -> DataFrame:
    """Stored rows with the non-null values of ``fresh`` rows of the same key in place; keys that aren't stored are left out."""
    cols = [c for c in fresh.columns if c != key]
    f = fresh.groupBy(key).agg(*[F.max(c).alias("_" + c) for c in cols])
    return stored.join(f, key, "left").select(*[F.coalesce("_" + c, F.col(c)).alias(c) if c in cols else F.col(c) for c in stored.columns])


def new_only(incoming: DataFrame, stored: DataFrame, key: str = "source_url") -> DataFrame:
    """Rows whose key isn't stored yet, each key once (the first by all columns); null keys are left out."""
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in incoming.columns if c != key])).alias("r")).select(key, "r.*")
    return first.select(*incoming.columns).join(stored.select(key).distinct(), key, "left_anti").select(*incoming.columns)


def replaced(children: DataFrame, fresh: DataFrame, keys: DataFrame, key: str = "action_id") -> DataFrame:
    """Children with those of ``keys`` taken out and ``fresh`` put in; missing columns become null."""
    return children.join(keys.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def bronze(items: DataFrame, today: str) -> DataFrame:
    """Stored form of scraped items: defaults for type, status, date and score; the id comes from the address, so a rerun gives the same rows."""
    return items.select(
        F.sha2("source_url", 256).alias("id"), F.upper("state").alias("state"), F.coalesce("date", F.lit(today).cast("date")).alias("date_announced"), F.lit("other").alias("action_type"), F.lit("announced").alias("status"), "headline", "source_url", F.lit(0.0).alias("quality_score"), F.col("body").alias("raw_text")
    )
