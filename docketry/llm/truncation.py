"""Problem 3: texts cut off by field limits, in SQL over word trigrams.

A text is read as words between blanks, each with its closing mark; words with
a capital count as ``A`` and numbers as ``0``, so that names don't scatter the
counts.  Trigrams are counted over the whole collection: how often they occur
and how often they are *terminal*, that is, close a text, a paragraph or, with
a stop, a sentence (what follows begins with a capital or a quotation).  The
final trigram of a text is joined with its counts: one that is frequent inside
texts but almost never terminal shows a break, whether a stop follows (as after
an abbreviation) or not, and one that often closes something is whole, even
without a stop (list items, headings).  Where a final trigram is rare (cuts in
mid-word make words that nobody else has), the counts of its shape take its
place: the kinds of its words and their marks.  Copies of one body count once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut

#: A trigram is frequent from this many occurrences; rarer ones are judged by their shape.
FREQUENT = 20
#: Ids that are broadcast, at most (about 60 bytes each).
BROADCAST_ROWS = 500_000
#: Highest share of a trigram's occurrences that close something for it to be almost never terminal.
TERMINAL = 0.2

#: What a cut may leave behind: dots, a broken character, entity or tag.
MARKS = r"(?:\\s|\\.\\.+|…|�|&#?\\w{0,6}$|<\\/?\\w{0,6}$|\\[\\s*(?:…|\\.\\.\\.|more|cut|truncated|continued)[^\\]]*\\]?$|\\((?:more|continued|cont\\.?|truncated)\\)$|(?i:\\bread more$|\\bcontinue reading$))+$"
#: Those marks and the final trigram are looked for in so many last pieces between blanks.
LAST = 16
#: Characters that mostly hold these pieces; where they don't the whole text is split.
NEAR = 600

#: Of a trigram g: A, 0 or a for each word, with a full stop or a comma for its closing mark.
SHAPE = r"""regexp_replace(regexp_replace(regexp_replace(g, '[^ .!?,;:"”’)\\]A0^]+', 'a'), '[.!?]["”’)\\]]*', '.'), '[,;:"”’)\\]]+', ',')"""

#: Common to both statements: bodies without what a cut leaves behind, and the masked words of a text.
_CUT = """
ended AS (
  SELECT id, state, left(body, length(body) - n) AS head, right(body, n) AS tail
  FROM (SELECT id, state, body, if(n < {near}, n, length(substring_index(replace(replace(body, '\n', ' '), '\t', ' '), ' ', -{last}))) AS n
    FROM (SELECT id, state, body, length(substring_index(replace(replace(right(body, {near}), '\n', ' '), '\t', ' '), ' ', -{last})) AS n FROM {bodies} WHERE body <> ''))
), cut AS (
  SELECT id, state, head, regexp_replace(tail, '{marks}', '') AS tail FROM ended
)
"""
_WORDS = "split(replace(replace(regexp_replace(regexp_replace({t}, '[A-ZÀ-ÖØ-Þ][A-Za-z0-9À-ÿ]*', 'A'), '[$]?[0-9]+(?:[.,][0-9]+)*', '0'), '\n', ' '), '\t', ' '), ' ')"

#: Trigrams of all texts: occurrences, and how many close a text, a paragraph (a blank line gives an empty word) or a sentence.
COUNTS = """
WITH {cut}, tokens AS (
  SELECT concat(array('^', '^'), {words}) AS t FROM (SELECT {hint} concat(head, tail) AS text FROM cut LEFT ANTI JOIN {copies} c ON cut.id = c.id) WHERE text <> ''
)
SELECT concat_ws(' ', w0, w1, w2) AS g, seen, closes FROM (
SELECT w0, w1, w2, count(*) AS seen,
       count_if(w3 IS NULL OR w3 = '' OR left(w3, 1) IN ('A', '"', '“', '‘') AND right(rtrim('"”’)]', w2), 1) IN ('.', '!', '?')) AS closes
FROM (SELECT inline(arrays_zip(t, slice(t, 2, size(t)), slice(t, 3, size(t)), slice(t, 4, size(t)))) AS (w0, w1, w2, w3) FROM tokens) WHERE w2 <> ''
GROUP BY w0, w1, w2)
"""

#: Final trigrams of all texts, from their last {last} pieces.
FINALS = """
WITH {cut}, tokens AS (
  SELECT id, state, concat(array('^', '^'), {words}) AS t FROM (SELECT *, tail AS text FROM cut) WHERE text <> ''
)
SELECT id, state, g, {shape} AS s FROM (SELECT id, state, concat_ws(' ', t[size(t) - 3], t[size(t) - 2], t[size(t) - 1]) AS g FROM tokens)
"""

#: Final trigrams, joined with their counts.
SQL = """
WITH trigram AS (
  SELECT c.g, c.seen, c.closes FROM {counts} c LEFT SEMI JOIN {finals} f ON f.g = c.g WHERE c.seen >= {frequent}
), shape AS (
  SELECT {shape} AS s, sum(seen) AS seen, sum(closes) AS closes FROM {counts} GROUP BY 1
)
SELECT id, state, g, by_shape, terminal_share, terminal_share <= {terminal} AS truncated FROM (
SELECT f.id, f.state, f.g, t.g IS NULL AS by_shape, coalesce(t.closes / t.seen, s.closes / s.seen, 0) AS terminal_share
FROM {finals} f LEFT JOIN trigram t ON f.g = t.g LEFT JOIN shape s ON f.s = s.s)
"""


def judge(bodies: DataFrame) -> DataFrame:
    """(id, state, g, by_shape, terminal_share, truncated) of every body with words; g is its final trigram.

    bodies: (id, state, body), materialised.  Null and empty bodies have no row.
    The collection's counts need a collection: in one of a few texts every
    trigram is rare and shapes decide.
    """
    spark, tag = bodies.sparkSession, uuid.uuid4().hex
    bodies.createOrReplaceTempView(f"bodies_{tag}")
    body = F.col("body")
    same = bodies.where("body <> ''").select("id", F.xxhash64(body).alias("h"), F.hash(body).alias("k"), F.length(body).alias("n"))
    # all copies of a body but the one with the smallest id
    first = same.groupBy("h", "k", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = cut(same.join(first, ["h", "k", "n"]).where("id <> first").select("id"))
    copies.createOrReplaceTempView(f"copies_{tag}")
    # few ids are sent to the texts; else the texts would be shuffled
    hint = "/*+ BROADCAST(c) */" if copies.count() <= BROADCAST_ROWS else ""
    common = {"copies": f"copies_{tag}", "cut": _CUT.format(bodies=f"bodies_{tag}", marks=MARKS, last=LAST, near=NEAR), "words": _WORDS.format(t="text"), "last": LAST, "near": NEAR, "shape": SHAPE, "hint": hint}
    cut(spark.sql(COUNTS.format(**common))).createOrReplaceTempView(f"counts_{tag}")
    cut(spark.sql(FINALS.format(**common))).createOrReplaceTempView(f"finals_{tag}")
    return spark.sql(SQL.format(counts=f"counts_{tag}", finals=f"finals_{tag}", shape=SHAPE, frequent=FREQUENT, terminal=TERMINAL))
