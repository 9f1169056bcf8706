"""Connected groups of an edge list by alternating star steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The folder that the session names; a folder of our own only on one machine, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docketry-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise as a compressed table in the shared folder and cut the lineage.

    A table read anew knows nothing of the plan that made it.  ``checkpoint``
    keeps that plan's constraints, and in a loop of self-joins these double
    every round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(e: DataFrame) -> DataFrame:
    """(x, y) of every link (u, v), in both directions."""
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("d")).select("d.x", "d.y")


def stars(e: DataFrame) -> DataFrame:
    """(x, label) of all vertices of the distinct links e (u < v); label is the smallest id of the group.

    A large star links every larger neighbour of x to the smallest one of x and
    its neighbours, a small star x and its smaller neighbours to the smallest
    of them; both keep the groups.  The rounds (about log squared of the
    vertices) go on until every vertex hangs on the smallest of its group.  A
    hot vertex' links are only reduced to a minimum, never gathered.
    """
    while True:
        d = both_ways(e)
        m = d.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        big = d.join(m, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()
        s = big.groupBy("v").agg(F.min("u").alias("m"))
        e = checkpointed(big.join(s, "v").select("m", F.explode(F.array("u", "v")).alias("w")).where("m <> w").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct())
        # done: nobody has two parents, and no parent has one
        n = e.agg(F.count("*"), F.count_distinct("v")).first()
        if n[0] == n[1] and e.select(F.col("u").alias("v")).join(e.select("v"), "v", "left_semi").isEmpty():
            roots = e.select(F.col("u").alias("x"), F.col("u").alias("label")).distinct()
            return e.select(F.col("v").alias("x"), F.col("u").alias("label")).union(roots)


def labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label): label is the smallest id of the group. Null ids and loops link nothing."""
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()
    return stars(checkpointed(e)).select(F.col("x").alias("id"), "label")
