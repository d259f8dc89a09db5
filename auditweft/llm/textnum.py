"""Vectorised word and shingle fingerprints of Arrow text columns.

A word is a run of bytes outside space and \\x09-\\x0D; A-Z count as a-z. Words get 64-bit
fingerprints from a polynomial over their bytes followed by a bit mixer, all with numpy over a
whole slice of a batch; nothing runs per word in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASE, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[0] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer (finaliser of the public splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's bounds in them (null: empty)."""
    import pyarrow.compute as pc

    col = pc.fill_null(col, "").cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; no word crosses a row's end."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | first[1:])) + 1
    rows = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes; works through long inputs piece by piece."""
    out = np.empty(len(starts), np.uint64)
    step = 1 << 18
    for k in range(0, len(starts), step):
        s, e = starts[k : k + step], ends[k : k + step]
        lo, hi = int(s[0]), int(e[-1])
        part = data[lo:hi]
        power, inverse = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        h = (sums[e - lo] - sums[s - lo]) * inverse[s - lo]
        out[k : k + step] = mix(h + (e - s).astype(np.uint64) * _BASE)
    return out


def combine(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix(h * _BASE + more)


def shingle_sets(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct fingerprints of its k-word shingles.

    With fewer words than k, the whole sequence is the one shingle; without words, none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= k:
        h = words[: len(words) - k + 1]
        for j in range(1, k):
            h = combine(h, words[j : len(words) - k + 1 + j])
    out = []
    for i in range(n_rows):
        a, c = first[i], counts[i]
        if c >= k:
            out.append(np.unique(h[a : a + c - k + 1]))
        elif c:
            one = words[a : a + 1]
            for j in range(1, c):
                one = combine(one, words[a + j : a + j + 1])
            out.append(combine(one, np.array([c], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
