"""Hashes of words and word shingles for whole batches of documents at once, in numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D; on UTF-8 that splits as it does on code points.
The hash of a word is a polynomial over a random table of its bytes, read off prefix sums, and then mixed.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents data[offsets[i]:offsets[i+1]]: each word's hash, start and end byte, and the n+1 places
    where the documents' words begin."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)  # places where a document begins, so that words do not run across
    first[offsets] = True
    solid = ~space
    start = solid.copy()
    start[1:] &= space[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= space[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    # the powers start anew in each block, so that their tables stay small
    block = 1 << 20
    h = np.empty(len(s), np.uint64)
    at = 0
    while at < len(s):
        base = s[at]
        last = int(np.searchsorted(s, base + block, "left"))
        last = max(last, at + 1)
        top = e[last - 1]
        up, down = _power(int(top - base))
        total = np.zeros(int(top - base) + 1, np.uint64)
        np.cumsum((_TABLE_LOWER if lower else _TABLE)[data[base:top]] * up, out=total[1:])
        h[at:last] = (total[e[at:last] - base] - total[s[at:last] - base]) * down[s[at:last] - base]
        at = last
    h = mix(h + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, offsets, "left")


_TURN = [np.uint64(pow(0xC2B2AE3D27D4EB4F | 1, k + 1, 1 << 64)) for k in range(64)]


def shingles(h: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `width` words inside a document, with the document's number. A document of fewer words
    has its whole sequence as one shingle; one without words has none."""
    n_words = np.diff(begin)
    n_docs = len(n_words)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), n_words)
    usable = len(h) - width + 1
    if usable > 0:
        x = h[:usable] * _TURN[0]
        for k in range(1, width):
            x = x + h[k : k + usable] * _TURN[k]
        inside = doc[:usable] == doc[width - 1 :]
        x, of = mix(x[inside]), doc[:usable][inside]
    else:
        x, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        y = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short):
            run = h[begin[d] : begin[d + 1]]
            y[j] = np.sum(run * np.array(_TURN[: len(run)], np.uint64)) + np.uint64(len(run))
        x, of = np.concatenate([x, mix(y)]), np.concatenate([of, short])
    return x, of


def distinct(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (document, hash) once, in that order."""
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    return x[keep], of[keep]
