"""Sizes of texts in tokens of a public tokenizer (byte-level BPE rank file)."""

from __future__ import annotations

import base64
import os
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank file of the tokenizer; a parameter of every function here.
RANKS = os.environ.get("DOCKETRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str = RANKS) -> DataFrame:
    """(key, *keep, tokens bigint) of every document; null and empty texts have 0 tokens."""
    types = dict(docs.dtypes)
    names = [key, *keep]

    def run(batches):
        e = encoding(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n, pa.int64())], names=[*names, "tokens"])

    return docs.select(*names, text).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", tokens bigint")
