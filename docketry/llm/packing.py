"""Problem 8: filling containers of fixed capacity, by hierarchical residual packing.

Round 0 packs parts of about PART_ITEMS items by best fit decreasing.  Bins
that are nearly full are emitted; all underfull ones become the items of the
next round, dealt anew to as many parts as their number asks for, so that bins
of different parts meet.  The rounds end when one part held all, or when a
round merges fewer than one in ``WORTH`` of its items: within a part no two bins
fit together after best fit.  A task never sees more than one part, and a
part's size doesn't depend on the input's.

A text above the capacity is cut into pieces of exactly the capacity and a
rest; every other text stays whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, stash

PART_ITEMS = 20_000
#: A round that merges fewer than one in so many items is the last.
WORTH = 1000
#: Rows of the table of capacities that are broadcast, at most; more are joined by shuffle.
BROADCAST_ROWS = 1000
#: Bins from this share of the capacity up are nearly full and emitted at once.
NEARLY_FULL = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin) by best fit decreasing; sizes are at most the capacity."""
    order = np.argsort(-sizes, kind="stable")
    bin_of = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f is set if a bin with f tokens free exists
    for i in order.tolist():
        s = int(sizes[i])
        m = mask >> s
        if m:
            free = s + (m & -m).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        fill[b] += s
        left = free - s
        by_free[left].append(b)
        mask |= 1 << left
        bin_of[i] = b
    return bin_of, np.array(fill, np.int64)


def _pack(batches, last: bool, round_: int):
    """One part per (pack_id, part) run of rows; emits the items with their bins, the fill and whether the bin goes on."""
    held, at = [], None

    def flush(rows, key):
        t = pa.Table.from_batches(rows)
        size = t.column("size").to_numpy()
        cap = int(t.column("capacity")[0].as_py())
        b, fill = best_fit(size, cap)
        on = np.full(len(fill), not last) & (fill < NEARLY_FULL * cap)
        names = np.array([f"{round_}.{key[1]}.{i}" for i in range(len(fill))], object)
        return pa.RecordBatch.from_arrays(
            [t.column("pack_id").combine_chunks(), t.column("capacity").combine_chunks(), t.column("item").combine_chunks(), pa.array(names[b], pa.string()), pa.array(fill[b]), pa.array(on[b])],
            names=["pack_id", "capacity", "item", "bin", "fill", "goes_on"],
        )

    for batch in batches:
        k = list(zip(batch.column("pack_id").to_pylist(), batch.column("part").to_pylist()))
        start = 0
        for i in range(1, len(k) + 1):
            if i == len(k) or k[i] != k[start]:
                if at is not None and k[start] != at:
                    yield flush(held, at)
                    held = []
                at = k[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield flush(held, at)


def _round(items: DataFrame, last: bool, n: int) -> DataFrame:
    """items: (pack_id, capacity, item, size, part)."""
    return (
        items.repartition("pack_id", "part")
        .sortWithinPartitions("pack_id", "part", "item")
        .mapInArrow(lambda it: _pack(it, last, n), "pack_id int, capacity int, item string, bin string, fill bigint, goes_on boolean")
    )


def pack(sizes: DataFrame, limits: DataFrame, key: str = "doc_id", part_items: int = PART_ITEMS) -> DataFrame:
    """(pack_id, bin_id, doc_id, piece, tokens, bin_tokens): every piece of every document in one bin of each pack.

    sizes: (key, tokens), materialised; texts without tokens take part with 0
    and use no space.  limits: (pack_id, capacity_tokens), a few rows; a null
    or non-positive capacity packs nothing.  Ties are broken by id, so a run
    on the same rows gives the same bins.
    """
    lim = _few(limits.where("capacity_tokens > 0").select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("int").alias("capacity")))
    n = sizes.count()
    parts = max(1, math.ceil(n / part_items))
    each = sizes.select(F.col(key).alias("doc_id"), "tokens").crossJoin(lim)
    whole = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / F.col("capacity")).cast("int")
    pieces = each.select("pack_id", "capacity", "doc_id", "tokens", F.posexplode(F.transform(F.sequence(F.lit(0), whole), lambda i: F.least(F.col("capacity").cast("bigint"), F.col("tokens") - i * F.col("capacity")))).alias("piece", "size"))
    pieces = pieces.withColumn("item", F.concat_ws("#", F.col("doc_id").cast("string"), "piece"))
    full = pieces.where("size = capacity").select("pack_id", F.concat(F.lit("f."), "item").alias("bin_id"), "doc_id", "piece", "size", F.col("size").alias("bin_tokens"))
    rest = pieces.where("size < capacity")
    items = rest.select("pack_id", "capacity", "item", "size", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    first = stash(_round(items, parts == 1, 0))  # the lazy result reads it
    moves, n_round, done = None, 0, first
    while parts > 1:
        goes = done.where("goes_on").groupBy("pack_id", "capacity", F.col("bin").alias("item")).agg(F.first("fill").alias("size"))
        held = [r[0] for r in goes.groupBy("pack_id").agg(F.count("*")).select(F.col("count(1)")).collect()]  # one row per capacity
        if not held:
            break
        parts = math.ceil(max(held) / part_items)
        n_round += 1
        nxt = goes.select("pack_id", "capacity", "item", "size", F.pmod(F.xxhash64("item", F.lit(n_round)), F.lit(parts)).cast("int").alias("part"))
        done = cut(_round(nxt, parts == 1, n_round))
        step = done.select("pack_id", F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("fill").alias("to_fill"))
        if moves is None:
            moves = step
        else:  # follow the bins that moved on again
            s = step.select("pack_id", F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("to_fill").alias("fill2"))
            moves = moves.join(s, ["pack_id", "to"], "left").select("pack_id", "bin", F.coalesce("to2", "to").alias("to"), F.coalesce("fill2", "to_fill").alias("to_fill"))
        if done.agg(F.count_distinct("pack_id", "bin")).first()[0] > sum(held) * (1 - 1 / WORTH):
            break
    binned = first.select("pack_id", "item", "bin", "fill")
    if moves is not None:
        binned = binned.join(cut(moves), ["pack_id", "bin"], "left").select("pack_id", "item", F.coalesce("to", "bin").alias("bin"), F.coalesce("to_fill", "fill").alias("fill"))
    size_of = sizes.select(F.col(key).cast("string").alias("d"), F.col(key).alias("doc_id"), "tokens")
    caps = lim.select("pack_id", "capacity")
    out = binned.select("pack_id", F.col("bin").alias("bin_id"), F.substring_index("item", "#", 1).alias("d"), F.substring_index("item", "#", -1).cast("int").alias("piece"), F.col("fill").alias("bin_tokens"))
    out = out.join(size_of, "d").join(caps, "pack_id").select("pack_id", "bin_id", "doc_id", "piece", (F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"), "bin_tokens")
    return out.unionByName(full.select("pack_id", "bin_id", "doc_id", "piece", F.col("size").alias("tokens"), "bin_tokens"))


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast where a count allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_id, capacity, bins, tokens, least_bins, fill_share): least_bins is what no packing can undercut."""
    b = packed.groupBy("pack_id").agg(F.count_distinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    lim = limits.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("bigint").alias("capacity"))
    return b.join(_few(lim), "pack_id").select("pack_id", "capacity", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("fill_share"))
