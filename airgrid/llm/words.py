"""Vectorised word splitting and hashing over UTF-8 bytes (numpy, inside tasks).

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z: ASCII letters and digits and every non-ASCII character.  No Python loop runs
per word, so a whole Arrow batch is hashed in a few array operations.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64


def _byte_table() -> np.ndarray:
    """0 for separators, else the (lower-cased) byte plus one."""
    t = np.zeros(256, dtype=np.uint64)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    t[keep] = np.array(keep, dtype=np.uint64) + _U(1)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


_TABLE = _byte_table()
_INSIDE = _TABLE != 0


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), wrapping arithmetic."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    p[0] = _U(1)
    return np.multiply.accumulate(p)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word of ``text`` in order; empty for null or wordless texts."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _INSIDE[raw]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    # Sum of byte * base**offset with offsets that restart at each word, so equal words
    # get equal sums wherever they stand.  Separators after a word add nothing to it.
    at, length = start - start[0], end - start
    raw = raw[start[0]:end[-1]]
    offset = np.arange(len(raw)) - np.repeat(at, np.diff(at, append=len(raw)))
    longest = int(length.max())
    term = _TABLE[raw]
    term *= _powers(longest + 1)[np.minimum(offset, longest, out=offset)]
    total = np.add.reduceat(term, at)
    total ^= length.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(total)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ words[j:j + n]) * _BASE + _U(2 * j + 1)
        h ^= h >> _U(29)
    return mix(h + _U(seed))


def occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each position."""
    if not len(values):
        return np.empty(0, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.arange(len(s)) - first
    return out
