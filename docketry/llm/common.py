"""Helpers shared by the operators: reading, checkpoints, words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docketry.operators.graph import checkpointed

WORD = re.compile(r"[^\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower())


#: Materialise and cut the lineage, in the shared folder.
cut = stash = checkpointed
