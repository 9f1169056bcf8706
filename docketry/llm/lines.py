"""Problem 6: lines and sequences of lines repeated across one source's documents.

PrefixSpan over line identifiers: a document is the sequence of its lines, a
line is identified by its letters.  Level 1 counts, by source, the documents
that hold a line; infrequent lines then leave the sequences, which are stored
once.  Level k + 1 projects the sequences on every frequent prefix of k lines
and counts the lines that follow it (with infrequent lines between them or
none), until a level is empty; there is no longest sequence.  Gaps over
*frequent* lines aren't projected on: every subset of a menu of m lines would be
a sequence, 2**m of them.  Each level is one narrow pass over the stored
sequences and one partially aggregated count; a hot source or line is reduced
before the shuffle.

Deleted are the occurrences of all frequent sequences, single lines included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, stash

LEAST_DOCS, LEAST_SHARE = 5, 0.04
#: Frequent sets up to this many rows are broadcast (16 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def line_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def _keys(text: Column) -> Column:
    """Hash of each line's letters; null for lines without any."""

    def one(x: Column) -> Column:
        k = line_key(x)
        return F.when(k != "", F.xxhash64(k))

    return F.transform(F.split(text, "\n"), one)


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def frequent_lines(docs: DataFrame, source: str = "state", text: str = "raw_text", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source, key, support) of the lines that occur in at least ``least_docs`` and ``least_share`` of the source's documents, materialised.

    All documents of a source count for the share, also those without text.
    A null source is a source of its own.
    """
    size = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"))
    held = docs.select(F.col(source).alias("source"), F.explode(F.array_distinct(_keys(F.col(text)))).alias("key")).where("key IS NOT NULL").groupBy("source", "key").agg(F.count("*").alias("support")).where(F.col("support") >= least_docs)
    s = F.broadcast(size) if size.count() <= BROADCAST_ROWS else size
    return cut(held.join(s, held["source"].eqNullSafe(s["source"])).where(F.col("support") >= least_share * F.col("docs")).select(held["source"], "key", "support", "docs"))


def project(docs: DataFrame, freq: DataFrame, key: str = "id", source: str = "state", text: str = "raw_text") -> DataFrame:
    """(row, key, source, seq, nos), materialised: each document's frequent lines in order and their numbers from 1; documents without any have no row."""
    a = docs.select(F.monotonically_increasing_id().alias("row"), key, F.col(source).alias("source"), F.col(text).alias("t"))
    rows = a.select("row", key, "source", F.posexplode(_keys(F.col("t"))).alias("pos", "line")).where("line IS NOT NULL")
    f = _hint(freq.select(F.col("source").alias("s"), F.col("key").alias("k")))
    held = rows.join(f, rows["source"].eqNullSafe(f["s"]) & (rows["line"] == f["k"]), "left_semi")
    # one row per document: as long as the document is
    at = held.groupBy("row").agg(F.first(key).alias(key), F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    return stash(at.select("row", key, "source", F.col("p.line").alias("seq"), F.transform("p.pos", lambda x: x + 1).alias("nos")))


def _grams(n: int, tail: int = 0) -> Column:
    """Hashes of the runs of n lines of ``seq`` without their last ``tail`` lines, by place."""
    last = F.size("seq") - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("seq", i, n - tail)))).otherwise(F.array().cast("array<bigint>"))


def prefix_span(projected: DataFrame, freq: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source, lines array<bigint>, h, length, support): all frequent sequences of ``project``'s documents; h identifies the sequence."""
    size = cut(freq.groupBy("source").agg(F.first("docs").alias("docs")))
    found = last = freq.select("source", F.array("key").alias("lines"), F.xxhash64(F.array("key")).alias("h"), F.lit(1).alias("length"), "support")
    n = 1
    while True:
        n += 1
        # what follows a frequent prefix: (prefix, sequence, its last line), once a document
        grams = projected.where(F.size("seq") >= n).select("source", F.explode(F.array_distinct(F.arrays_zip(_grams(n, 1).alias("p"), _grams(n).alias("h"), F.slice("seq", F.lit(n), F.size("seq")).alias("x")))).alias("g")).select("source", "g.*")
        p = _hint(last.select(F.col("source").alias("s"), F.col("h").alias("ph"), "lines"))
        counts = grams.groupBy("source", "p", "h", "x").agg(F.count("*").alias("support")).where(F.col("support") >= least_docs)
        grown = counts.join(p, counts["source"].eqNullSafe(p["s"]) & (counts["p"] == p["ph"])).select("source", F.concat("lines", F.array("x")).alias("lines"), "h", F.lit(n).alias("length"), "support")
        s = _hint(size.select(F.col("source").alias("s"), "docs"))
        last = cut(grown.join(s, grown["source"].eqNullSafe(s["s"])).where(F.col("support") >= least_share * F.col("docs")).select(*found.columns))
        if last.isEmpty():
            return found
        found = found.unionByName(last)


def closed(found: DataFrame) -> DataFrame:
    """Sequences that no longer one with the same support begins or ends with."""
    inner = found.where("length > 1").select("source", F.explode(F.array(F.xxhash64(F.expr("slice(lines, 1, length - 1)")), F.xxhash64(F.expr("slice(lines, 2, length - 1)")))).alias("h"), "support").distinct()
    i = inner.select(F.col("source").alias("s"), F.col("h").alias("g"), F.col("support").alias("n"))
    return found.join(i, found["source"].eqNullSafe(i["s"]) & (found["h"] == i["g"]) & (found["support"] == i["n"]), "left_anti")


def covered(projected: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """(row, key, source, line_no): the lines of each document that lie in an occurrence of a sequence of ``found``."""
    lengths = [r[0] for r in found.select("length").distinct().collect()] or [1]  # as many as levels
    f = _hint(found.select(F.col("source").alias("s"), F.col("h").alias("g"), F.col("length").alias("n")))

    def runs(n: int) -> Column:
        return F.transform(_grams(n), lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("i"), h.alias("h")))

    each = F.flatten(F.array(*map(runs, sorted(lengths))))
    met = projected.select("row", "source", F.explode(each).alias("e")).select("row", "source", "e.*")
    met = met.join(f, met["source"].eqNullSafe(f["s"]) & (met["h"] == f["g"]) & (met["n"] == f["n"]), "left_semi")
    # of the runs that begin at one line the longest covers the others
    longest = met.groupBy("row", "i").agg(F.max(met["n"]).alias("n"))
    places = longest.select("row", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    return places.join(projected.select("row", key, "source", "nos"), "row").select("row", key, "source", F.element_at("nos", F.col("i") + 1).alias("line_no"))


def repeated(docs: DataFrame, key: str = "id", source: str = "state", text: str = "raw_text", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(row, key, source, line_no): every line that belongs to a frequent sequence of its source."""
    freq = frequent_lines(docs, source, text, least_docs, least_share)
    p = project(docs, freq, key, source, text)
    return covered(p, prefix_span(p, freq, least_docs, least_share), key)


def without(docs: DataFrame, lines: DataFrame, key: str = "id", source: str = "state", text: str = "raw_text") -> DataFrame:
    """(key, source, cleaned, removed): every document without ``lines`` (key, line_no), in one pass; null texts stay null.

    Documents with equal keys lose the lines of all of them.
    """
    gone = lines.groupBy(F.col(key).alias("k")).agg(F.collect_set("line_no").alias("gone"))
    a = docs.select(key, F.col(source).alias("source"), F.col(text).alias("t"))
    numbered = F.transform(F.split("t", "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("no")))
    kept = F.filter(numbered, lambda p: ~F.coalesce(F.array_contains("gone", p["no"]), F.lit(False)))
    return a.join(gone, a[key] == gone["k"], "left").select(
        key, "source", F.when(F.col("t").isNotNull(), F.array_join(F.transform(kept, lambda p: p["x"]), "\n")).alias("cleaned"), F.when(F.col("t").isNotNull(), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))).otherwise(0).alias("removed")
    )
