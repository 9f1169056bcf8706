"""Queries pN_ over the tables of TESTDATA.md, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import components, lines, mixing, names, neardup, packing, pages, repetition, tokens, truncation
from docketry.llm.common import stash, table


#: Two bodies are a case from this similarity of their three-word sequences up (TESTDATA.md).
P1_LEAST, P1_WORDS = 0.5, 3


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose releases are near-duplicates."""
    sk = neardup.page_sketches(table(spark, d, "enforcement_actions"), P1_WORDS)
    return neardup.member_pairs(sk, neardup.class_links(sk, P1_LEAST))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record that is no residue with its class of equal releases and the number of classes linked to it."""
    sk = neardup.page_sketches(table(spark, d, "enforcement_actions"), P1_WORDS)
    return neardup.classes(sk, neardup.class_links(sk, P1_LEAST))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class and links, for sequences of five words and a similarity from 0.8 up."""
    sk = stash(neardup.sketches(table(spark, d, "documents"), "doc_id", "text", 5))
    return neardup.classes(sk, neardup.class_links(sk, 0.8), "doc_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(stash(pages.read_pages(table(spark, d, "enforcement_actions"), ("body",), ("id", "state"), cases=False)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose release breaks off."""
    return _judged(spark, d).where("truncated").select("id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per state: all records, truncated ones and their share."""
    a = table(spark, d, "enforcement_actions")
    total = a.groupBy("state").agg(F.count("*").cast("bigint").alias("records"))
    cutoff = _judged(spark, d).where("truncated").groupBy("state").agg(F.count("*").cast("bigint").alias("truncated"))
    return total.join(cutoff, "state", "left").select("state", "records", F.coalesce("truncated", F.lit(0)).cast("bigint").alias("truncated"), F.round(F.coalesce("truncated", F.lit(0)) / F.col("records"), 6).alias("rate"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked action with the smallest id of its group."""
    return components.components(table(spark, d, "dedup_matches")).select(F.col("id").alias("action_id"), "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of defendants rows that mean the same person or organisation."""
    return names.pairs(names.entities(table(spark, d, "defendants")))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every defendants row that names somebody, with its entity."""
    return names.entities(table(spark, d, "defendants"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each line that recurs excessively in its state."""
    return lines.repeated(table(spark, d, "enforcement_actions")).select("id", "line_no")


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Closed frequent sequences of lines per state."""
    a = table(spark, d, "enforcement_actions")
    freq = lines.frequent_lines(a)
    return lines.closed(lines.prefix_span(lines.project(a, freq), freq)).select(F.col("source").alias("state"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "length", F.col("support").cast("bigint").alias("support"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every record without the lines that recur excessively in its state."""
    a = table(spark, d, "enforcement_actions")
    return lines.without(a, lines.repeated(a))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    sizes = stash(tokens.sizes(table(spark, d, "documents")))
    return packing.pack(sizes, table(spark, d, "pack_limits"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and their fill, by capacity."""
    return packing.report(p8_packed(spark, d), table(spark, d, "pack_limits"))


def _mix(spark: SparkSession, d: str, whole: bool = False):
    sizes = stash(tokens.sizes(table(spark, d, "documents"), keep=("source",)))
    total = sizes.agg(F.sum("tokens")).first()[0] if whole else None
    return mixing.mix(sizes, table(spark, d, "mix_targets"), total)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, in order of its slots."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each source."""
    return mixing.shares(*_mix(spark, d))


def p9_whole_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same for a mix as large as all documents together: scarce sources reach their repeats and fall short."""
    return mixing.shares(*_mix(spark, d, whole=True))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which at least 0.4 of the words are repeated content."""
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated content and the score of every document."""
    return repetition.measure(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose headline or text is template residue, filler or an error page."""
    a = table(spark, d, "enforcement_actions")
    return pages.read_pages(a, (), cases=True).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the text that belong to the page and not to the release."""
    a = table(spark, d, "enforcement_actions")
    return pages.read_pages(a, ("site",), cases=False).select("id", F.explode("site").alias("line_no"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every record with what remains of its text."""
    a = table(spark, d, "enforcement_actions")
    return pages.read_pages(a, ("body",), cases=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_documents": p1_documents,
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p6_found": p6_found,
    "p6_sequences": p6_sequences,
    "p6_cleaned": p6_cleaned,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_whole_shares": p9_whole_shares,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}
_P6_KEYS = """
WITH l AS (
  SELECT id, state, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no
  FROM enforcement_actions
), k AS (
  SELECT id, state, line_no, line, lower(regexp_replace(line, '[^\\p{L}]', '', 'g')) AS key FROM l
), freq AS (
  SELECT k.state, k.key FROM (SELECT state, key, count(DISTINCT id) AS n FROM k WHERE key <> '' GROUP BY ALL) k
  JOIN (SELECT state, count(*) AS docs FROM enforcement_actions GROUP BY state) s ON s.state = k.state
  WHERE n >= 5 AND n >= 0.04 * docs
)
"""

ORACLES: dict[str, str] = {
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT lower(trim(action_id_a)) AS a, lower(trim(action_id_b)) AS b FROM dedup_matches
  WHERE trim(action_id_a) <> '' AND trim(action_id_b) <> '' AND lower(trim(action_id_a)) <> lower(trim(action_id_b))
), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, b AS y FROM d UNION SELECT r.x, d.b FROM r JOIN d ON d.a = r.y)
SELECT x AS action_id, min(least(x, y)) AS group_id FROM r GROUP BY x
""",
    "p6_found": _P6_KEYS + "SELECT k.id, CAST(k.line_no AS INT) AS line_no FROM k JOIN freq f ON f.state = k.state AND f.key = k.key",
    "p10_found": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents
), g AS (
  SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), s AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + 4], ' ') AS g FROM g
), r AS (
  SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again FROM s
), c AS (
  SELECT DISTINCT doc_id, n, i + k AS word FROM r, (SELECT unnest(range(0, 5)) AS k) WHERE again
)
SELECT doc_id FROM c GROUP BY doc_id, n HAVING count(*) >= 0.4 * n
""",
}
