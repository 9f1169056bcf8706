"""Words of a batch of texts as numpy arrays of hashes.

A batch is decoded once to code points; look-up tables say which code points
are letters or digits and give their lower case, and a polynomial prefix sum
gives the hash of every word without a Python loop.  Exact for the definition
"maximal runs of letters and digits, lower-cased" up to 64-bit collisions;
the few letters whose lower case is several code points keep their first.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    size = 0x20000
    low = np.arange(size, dtype=np.uint32)
    word = np.zeros(size, dtype=bool)
    for c in range(size):
        ch = chr(c)
        if ch.isalnum():
            word[c] = True
            low[c] = ord(ch.lower()[0])
    return low, word


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _R)]), np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _RINV)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, document of every word) in order."""
    joined = "\0".join(t or "" for t in texts)
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    low, is_word = _tables()
    inside = cp < len(low)
    safe = np.where(inside, cp, 0)
    word = is_word[safe]
    if not inside.all():  # rare planes
        for i in np.flatnonzero(~inside):
            word[i] = chr(cp[i]).isalnum()
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # position within the word limits the powers that are needed
    wid = np.cumsum(edge[:-1] == 1) - 1
    pos = np.arange(len(cp)) - start[np.maximum(wid, 0)]
    pos = np.where(word, pos, 0)
    p, _ = _powers(1 << max(4, int(pos.max()).bit_length()))
    with np.errstate(over="ignore"):
        v = np.where(word, (np.where(inside, low[safe], cp).astype(np.uint64) + np.uint64(1)) * p[pos], np.uint64(0))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
        h = mix(sums[end] - sums[start] + (end - start).astype(np.uint64))
    # document of a word: separators before its start
    seps = np.cumsum(cp == 0)
    return h, seps[start]


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, index of the first word) of every run of ``n`` words of one document."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g = g * np.uint64(0x100000001B3) + h[k : k + m]
    same = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[same]), doc[same], same
