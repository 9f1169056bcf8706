"""Problem 10: the share of repeated content inside each document.

Every word of a document is a feature: the hash bucket of the run of five words
that begins at it, and whether it lies in a run that began earlier in the same
document.  Two multinomials over these features are counted, one of the
*trusted target* (documents in which no run repeats) and one of the raw corpus,
each smoothed by ``PRIOR`` of its size towards independence of bucket and mark.
A document's score is the log-likelihood ratio of raw against target, divided
by its number of words.  First occurrences weigh about nothing in it and
repeats much, so the score rises with the share of repeated content.

The counts cover the whole corpus and are gathered as two arrays of fixed
length (``BUCKETS``).  All documents are thresholded at the score that a
document of ``NEAR`` of the wanted share has with average features; buckets
move a score by a few per cent, so what the threshold lets through is about the
wanted set, and an exact check of the share follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.textvec import gram_hashes, word_hashes

N = 5
#: Hash buckets of first occurrences; repeats have as many.
BUCKETS = 4096
LEAST_SHARE = 0.4
#: The threshold lies at the score of this part of the wanted share.
NEAR = 0.85
#: Weight of independence of bucket and mark, as a part of a corpus's size.
PRIOR = 1.0
#: Texts of one numpy pass: bounds the memory of a task whatever the batch.
CHUNK_CHARS = 2_000_000


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of about CHUNK_CHARS characters; a longer text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > CHUNK_CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def repeats(texts: list[str | None], n: int = N):
    """Per text: words, repeated words, runs, repeated runs; and (document, bucket, repeated) of each word of texts with runs."""
    h, doc = word_hashes(texts)
    g, gdoc, first = gram_hashes(h, doc, n)
    k = len(texts)
    order = np.lexsort((first, g, gdoc))
    gs, ds = g[order], gdoc[order]
    again = np.zeros(len(g), bool)
    if len(g):
        again[order[1:]] = (gs[1:] == gs[:-1]) & (ds[1:] == ds[:-1])
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + n, -1)
    covered = np.cumsum(cover[:-1]) > 0
    count = lambda d, w=None: np.bincount(d, w, minlength=k)
    runs = count(gdoc)
    # a text's last words have the bucket of its last run
    at = np.zeros(len(h), np.int64)
    at[first] = np.arange(len(g))
    at = np.maximum.accumulate(at)
    some = runs[doc] > 0
    bucket = (g % np.uint64(BUCKETS)).astype(np.int64)
    return count(doc), count(doc, covered).astype(np.int64), runs, count(gdoc, again).astype(np.int64), (doc[some], bucket[at[some]] if len(g) else at[some], covered[some])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(target, bucket, n): word counts by feature; repeats have buckets from BUCKETS on.  At most 4 * BUCKETS rows leave a task's aggregation."""

    def run(batches):
        total = np.zeros((2, 2 * BUCKETS), np.int64)
        for b in batches:
            for _, part in chunks(b.column(0).to_pylist()):
                _, _, _, rep, (d, bucket, again) = repeats(part)
                clean = rep[d] == 0
                np.add.at(total, (clean.astype(int), bucket + again * BUCKETS), 1)
        t, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t == 1), pa.array(f.astype(np.int32)), pa.array(total[t, f])], names=["target", "bucket", "n"])

    return docs.select(text).mapInArrow(run, "target boolean, bucket int, n bigint").groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, float, float]:
    """(log P(feature | raw) - log P(feature | target), its mean over first occurrences, over repeats); bounded by 4 * BUCKETS rows."""
    raw, target = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for t, f, n in features(docs, text).collect():
        raw[f // BUCKETS, f % BUCKETS] += n
        if t:
            target[f // BUCKETS, f % BUCKETS] += n
    share = (raw.sum(0) + 1) / (raw.sum() + BUCKETS)

    def logp(n: np.ndarray) -> np.ndarray:
        total = n.sum()
        mark = (n.sum(1) + 0.5) / (total + 1)
        most = PRIOR * total + 1
        return np.log((n + most * mark[:, None] * share) / (total + most))

    weight = logp(raw) - logp(target)
    first, again = (float((weight[m] * (raw[m] + share)).sum() / (raw[m].sum() + 1)) for m in (0, 1))
    return weight.ravel(), first, again


def least_score(first: float, again: float, share: float = LEAST_SHARE) -> float:
    """Score of a document of average features in which ``NEAR`` of ``share`` is repeated content."""
    return NEAR * share * again + (1 - NEAR * share) * first


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = LEAST_SHARE) -> DataFrame:
    """(key, words, repeated_words, repeated_share, score, above) of every document.

    Null, empty and shorter texts than five words have share 0 and score 0.
    Whole texts are read; the work is linear in their length.
    """
    weight, *means = fit(docs, text)
    least = least_score(*means, share)
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        w = shared.value
        for b in batches:
            for at, part in chunks(b.column(1).to_pylist()):
                words, rep, runs, _, (d, bucket, again) = repeats(part)
                n = np.maximum(words, 1)
                score = np.bincount(d, w[bucket + again * BUCKETS], minlength=len(part)) / n
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(words), pa.array(rep), pa.array(rep / n), pa.array(score), pa.array((score >= least) & (runs > 0))], names=[key, "words", "repeated_words", "repeated_share", "score", "above"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, words bigint, repeated_words bigint, repeated_share double, score double, above boolean")


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = LEAST_SHARE) -> DataFrame:
    """Documents above the score's threshold; the exact share of what passes is checked."""
    return measure(docs, key, text, share).where(F.col("above") & (F.col("repeated_share") >= share))
