"""Problem 9: mixing sources to target weights by a low-discrepancy schedule.

The total is the largest one at which every source can give its share within
its repeats (or a wanted total; then sources that fall short are capped and the
others take over their missing part in proportion).  A source's documents are
shuffled by hash and cut into blocks of equal tokens.  Slot i of the schedule
is the golden-ratio point frac(i * phi) mapped through the cumulative weights;
the k-th slot of a source takes its block k modulo the number of blocks, so
every stretch of the schedule has about the target shares and repeats of a
document lie as far apart as can be.

Ranks and running sums over a source are formed in two levels (buckets of the
hash, chunks of the schedule), so that no task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 512
#: Documents of one bucket of a source, about; slots of one chunk of the schedule.
BUCKET_DOCS, CHUNK = 50_000, 100_000
#: Sources of the targets, at most: the plan is made on the driver.
MOST_SOURCES = 10_000
#: Fixed value: the fractional part of the golden ratio.
PHI = 0.6180339887498949


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per source of ``targets``: available tokens and those it is to give; more than ``MOST_SOURCES`` targets raise an error.

    Null, repeated or non-positive targets and sources without tokens give
    nothing; what they would have given goes to the others in proportion.
    """
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = [r.asDict() for r in t.join(have, "source", "left").orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the table of targets")
    live = [r for r in rows if (r["tokens"] or 0) > 0 and r["repeats"] > 0]
    for r in rows:
        r["tokens"], r["docs"], r["give"] = r["tokens"] or 0, r["docs"] or 0, 0.0
    if not live:
        return rows
    whole = sum(r["target"] for r in live)
    if total is None:
        total = min(r["repeats"] * r["tokens"] / (r["target"] / whole) for r in live)
    left, rest = float(total), list(live)
    while rest and left > 0:
        w = sum(r["target"] for r in rest)
        short = [r for r in rest if r["repeats"] * r["tokens"] < left * r["target"] / w - 1e-9]
        if not short:
            for r in rest:
                r["give"] = left * r["target"] / w
            break
        for r in short:
            r["give"] = float(r["repeats"] * r["tokens"])
        left -= sum(r["give"] for r in short)
        rest = [r for r in rest if r not in short]
    return rows


def _blocks(sizes: DataFrame, block: int, key: str) -> DataFrame:
    """(source, block, key, tokens): documents of a source in hash order, by the block in which they begin."""
    h = F.xxhash64(F.lit("mix"), key)
    n = F.broadcast(sizes.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET_DOCS)).alias("n")))
    # buckets are ranges of the hash, in order
    a = sizes.withColumn("h", h).join(n, "source").withColumn("bucket", F.floor((F.col("h") / F.lit(float(1 << 63)) + 1) / 2 * F.col("n")).cast("long"))
    a = a.select("source", "bucket", "h", key, "tokens")
    sums = a.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("before"))
    w = Window.partitionBy("source", "bucket").orderBy("h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = a.withColumn("run", F.sum("tokens").over(w) - F.col("tokens")).join(before, ["source", "bucket"])
    return at.select("source", F.floor((F.col("before") + F.col("run")) / block).cast("long").alias("block"), key, "tokens")


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, key: str = "doc_id") -> tuple[DataFrame, list[dict]]:
    """((slot, source, repeat, key, tokens), plan): the mix in order of its slots.

    sizes: (key, source, tokens), materialised.  Documents without a source or
    tokens aren't mixed.  ``repeat`` counts from 0 and stays below the
    source's max_repeats.
    """
    spark = sizes.sparkSession
    s = sizes.where("source IS NOT NULL AND tokens > 0")
    rows = plan(s, targets, total)
    live = [r for r in rows if r["give"] > 0]
    if not live:
        return s.limit(0).select(F.lit(0).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("repeat"), key, "tokens"), rows
    for r in live:
        r["blocks"] = math.ceil(r["tokens"] / block)
        # slots of a source: what it gives over what one of its blocks holds on average
        r["quota"] = max(1, min(round(r["give"] * r["blocks"] / r["tokens"]), r["repeats"] * r["blocks"]))
    slots = sum(r["quota"] for r in live)
    # cumulative weights of the sources: at most as many as targets
    steps, run = [], 0.0
    for r in live:
        run += r["quota"] / slots
        steps.append(run)
    slots += len(live)  # a source whose points come late has its quota in the end, too
    i = spark.range(0, slots, 1, max(1, min(slots // CHUNK + 1, 10_000)))
    u = F.pmod(F.col("id") * F.lit(PHI) + F.lit(0.5), F.lit(1.0))
    names = F.array(*[F.lit(r["source"]) for r in live])
    upto = F.array(*[F.lit(x) for x in steps[:-1]], F.lit(2.0))
    which = F.size(F.filter(upto, lambda x: x <= F.col("u"))) + 1
    sched = i.withColumn("u", u).select(F.col("id").alias("slot"), F.element_at(names, which).alias("source"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = sched.groupBy("chunk", "source").agg(F.count("*").alias("n"))
    before = counts.select("chunk", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")) - 1
    ranked = sched.withColumn("r", rank).join(before, ["chunk", "source"]).select("slot", "source", (F.col("before") + F.col("r")).alias("k"))
    size = F.broadcast(spark.createDataFrame([(r["source"], r["blocks"], r["repeats"], r["quota"]) for r in live], "source string, blocks long, repeats long, quota long"))
    # discrepancy may give a source a slot more than its share: its quota holds
    takes = ranked.join(size, "source").where("k < quota").select("slot", "source", F.floor(F.col("k") / F.col("blocks")).alias("repeat"), F.pmod("k", "blocks").alias("block"), "repeats").where("repeat < repeats")
    b = _blocks(s.select("source", key, "tokens"), block, key)
    return takes.join(b, ["source", "block"]).select("slot", "source", "repeat", key, "tokens"), rows


def shares(mixed: DataFrame, rows: list[dict]) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, most_repeats) of a mix, one row per source of the targets."""
    spark = mixed.sparkSession
    t = spark.createDataFrame([(r["source"], r["target"], r["repeats"]) for r in rows], "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    all_ = got.agg(F.sum("tokens").alias("whole"))
    return t.join(got, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("share"), F.coalesce("most_repeats", F.lit(0)).cast("bigint").alias("most_repeats")
    )
