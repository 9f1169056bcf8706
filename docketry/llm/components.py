"""Problem 4: one group identifier for everything linked directly or through others.

Rounds of stripping and compressing reduce the graph: vertices of degree one
are taken off, then chains of vertices of degree two are compressed by list
ranking (pointer doubling over directed edges, so that a chain of n takes log n
rounds).  Both leave new vertices of degree one and two, so the rounds go on
until nothing is left to take; a tree is used up in a number of rounds that
grows with the logarithm of its size.  The core that remains (every vertex of
degree three or more) is solved by alternating star steps, and the labels are
carried back to the chains and the stripped vertices.  Every step is a shuffle
join or a partially aggregated group-by on vertex ids; nothing but counts
reaches the driver.  Hot vertices are safe: a vertex's edges are never gathered
in one row, only counted or reduced to a minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docketry.llm.common import cut
from docketry.operators.graph import both_ways as _both
from docketry.operators.graph import stars


def clean_links(pairs: DataFrame, a: str = "action_id_a", b: str = "action_id_b") -> DataFrame:
    """Distinct undirected links (u < v) of trimmed, lower-cased ids; null, empty and equal ids link nothing."""
    ida, idb = (F.lower(F.trim(F.col(f"`{c}`"))) for c in (a, b))
    return (
        pairs.select(F.least(ida, idb).alias("u"), F.greatest(ida, idb).alias("v"), ida.alias("a"), idb.alias("b"))
        .where("a <> '' AND b <> '' AND a <> b")
        .select("u", "v")
        .distinct()
    )


def _strip(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining edges, and (x, parent) of the vertices of degree one."""
    # of a degree-one vertex min(y) is its only neighbour
    one = _both(e).groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("y")).where("n = 1").select("x", "y")
    both = one.select(F.col("x").alias("y"), F.lit(True).alias("also"))
    # of two vertices that have only each other the smaller stays as the root
    gone = cut(one.join(both, "y", "left").where("also IS NULL OR x > y").select("x", F.col("y").alias("parent")))
    left = e.join(gone.select(F.col("x").alias("u")), "u", "left_anti").join(gone.select(F.col("x").alias("v")), "v", "left_anti").select("u", "v")
    return cut(left), gone


def _compress(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between chain ends, and (x, parent) of the chains' inner vertices.

    Inner vertices have degree two.  An arc (x, y) with inner y is followed by
    the arc (y, z), z the other neighbour of y.  Doubling finds for every arc
    the head of the last one; cycles of inner vertices only have none and take
    their smallest id.
    """
    d = _both(e)
    inner = d.groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("n = 2").select(F.col("x").alias("y"), "lo", "hi")
    arcs = d.join(inner, "y")
    other = F.when(F.col("x") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    # the arc (x, y); its path so far ends in (px, py), inner means that py still is one; low is the smallest id passed
    p = arcs.select("x", "y", F.col("y").alias("px"), other.alias("py"), F.col("y").alias("low"))
    ids = inner.select(F.col("y").alias("py"), F.lit(True).alias("inner"))
    p, open_, _ = _counted(p.join(ids, "py", "left").select("x", "y", "px", "py", "low", F.coalesce("inner", F.lit(False)).alias("inner"), F.lit(True).alias("moved")))
    last, moved = -1, 1
    # a round that closes no path and moves no minimum leaves cycles only, and their minima are known
    while open_ and (open_ != last or moved):
        last = open_
        nxt = p.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("low").alias("qlow"), F.col("inner").alias("qinner"))
        p, open_, moved = _counted(
            p.join(nxt, ["px", "py"], "left").select(
                "x", "y", F.when(F.col("inner"), F.col("qx")).otherwise(F.col("px")).alias("px"), F.when(F.col("inner"), F.col("qy")).otherwise(F.col("py")).alias("py"),
                F.when(F.col("inner"), F.least("low", "qlow")).otherwise(F.col("low")).alias("low"), F.when(F.col("inner"), F.col("qinner")).otherwise(F.col("inner")).alias("inner"), (F.col("inner") & (F.col("qlow") < F.col("low"))).alias("moved"),
            )
        )
    # each inner vertex y has two arcs into it; their path ends are the chain's ends
    ends = p.groupBy("y").agg(F.min("py").alias("a"), F.max("py").alias("b"), F.min("low").alias("low"), F.bool_or("inner").alias("cycle"))
    ends = cut(ends)
    parents = ends.select(F.col("y").alias("x"), F.when(F.col("cycle"), F.col("low")).otherwise(F.col("a")).alias("parent"))
    gone = ends.select("y")
    kept = e.join(gone.select(F.col("y").alias("u")), "u", "left_anti").join(gone.select(F.col("y").alias("v")), "v", "left_anti")
    links = ends.where("NOT cycle AND a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return cut(kept.select("u", "v").union(links).distinct()), parents.where("x <> parent")


def _counted(p: DataFrame) -> tuple[DataFrame, int, int]:
    """``p`` materialised, how many of its arcs still have an inner end, and of how many the minimum moved; all in one job."""
    seen = Observation()
    p = cut(p.observe(seen, F.count_if("inner").alias("open"), F.count_if("moved").alias("moved")))
    return p, int(seen.get["open"]), int(seen.get["moved"])


def groups(links: DataFrame) -> DataFrame:
    """(id, group_id) of every vertex of ``links`` (u, v); group_id is the smallest id of the group.

    An empty input gives an empty result; repeated and reversed links make no difference.
    """
    first = e = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    removed: list[DataFrame] = []
    n, last = e.count(), -1
    while n and n != last:
        e, gone = _strip(e)
        removed.append(gone)
        last, n = n, e.count()
        if not n or removed[1:] and n == last:
            break  # nothing to strip, and the chains are compressed
        e, chains = _compress(e)
        removed.append(chains)
        n = e.count()
    label = cut(stars(e)) if n else first.select(F.col("u").alias("x"), F.col("u").alias("label")).limit(0)
    for gone in reversed(removed):
        # a parent without a label is the root of its own tree
        back = gone.join(label.select(F.col("x").alias("parent"), F.col("label").alias("of")), "parent", "left").select("x", F.coalesce("of", "parent").alias("label"))
        label = cut(label.unionByName(back))
    vertices = first.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    full = cut(vertices.join(label, "x", "left").select("x", F.coalesce("label", "x").alias("label")))
    low = full.groupBy("label").agg(F.min("x").alias("group_id"))
    return full.join(low, "label").select(F.col("x").alias("id"), "group_id")


def components(pairs: DataFrame, a: str = "action_id_a", b: str = "action_id_b") -> DataFrame:
    return groups(clean_links(pairs, a, b))


def group_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("group_id").agg(F.count("*").cast("bigint").alias("members"))
