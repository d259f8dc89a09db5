"""Distinct words of a batch: spelling features by hashing, and rows derived once per word."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .textnum import mix, word_hashes

_NOT_LETTER = re.compile(r"[^\w\n]|[\d_]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letters_only(words: list[bytes]) -> list[str]:
    """Lower-case letters of each word ('' without any)."""
    text = b"\n".join(words).decode("utf-8", "replace").lower()
    out = _NOT_LETTER.sub("", text).split("\n")
    return [w if not w or w.isalpha() else "".join(c for c in w if c.isalpha()) for w in out]


def ngram_buckets(words: list[str], orders: tuple[int, ...], buckets: int, start_only: tuple[int, ...] = (), whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of ``^word$``, and where each word's begin (every word has one).

    ``orders`` are taken at every place, ``start_only`` at the word's start; ``whole`` adds the word.
    """
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode(), np.uint8)
    first = text == 2
    word = np.cumsum(first) - 1
    wide = text.astype(np.uint64) + np.uint64(1)
    ids, owner = [], []
    for n in sorted({*orders, *start_only}):
        if n > len(text):
            continue
        h = np.zeros(len(text) - n + 1, np.uint64)
        for j in range(n):
            h = h * _STEP + wide[j : len(text) - n + 1 + j]
        ok = word[: len(h)] == word[n - 1 :]
        if n not in orders:
            ok &= first[: len(h)]
        ids.append(mix(h[ok] + np.uint64(n)))
        owner.append(word[: len(h)][ok])
    if whole or not ids:
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(text))
        ids.append(mix(word_hashes(text, starts, ends, lower=False) + np.uint64(99)))
        owner.append(np.arange(len(starts)))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    by_word = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return (ids[by_word] % np.uint64(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]])


class Slots:
    """Numbers of 64-bit keys, in two possible slots each; nothing is sorted.

    A key that finds both slots taken pushes another out, which is then unknown again.
    """

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h & self.mask).astype(np.int64), ((h >> np.uint64(32)) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of every key, -1 if unknown."""
        a, b = self._places(h)
        out = np.where(self.keys[a] == h, self.numbers[a], -1)
        miss = np.flatnonzero(out < 0)
        b = b[miss]
        out[miss] = np.where(self.keys[b] == h[miss], self.numbers[b], -1)
        return out

    def put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are unknown."""
        a, b = self._places(h)
        at = np.where(self.numbers[a] < 0, a, b)
        self.keys[at], self.numbers[at] = h, numbers

    def clear(self) -> None:
        self.numbers.fill(-1)


class Known:
    """Distinct words and their numbers, up to ``cap`` of them at a time (more if one text has more)."""

    def __init__(self, cap: int):
        self.cap, self.used = cap, 0
        self.slots = Slots(max(16, (2 * cap).bit_length()))

    def numbers(self, h: np.ndarray, learn: Callable[[np.ndarray], None], forget: Callable[[], None]) -> np.ndarray:
        """Numbers of the fingerprints ``h``; ``learn`` gets the places of the new ones, in the order of their numbers."""
        out = self.slots.find(h)
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out
        own, first = np.unique(h[miss], return_index=True)
        if self.used and self.used + len(own) > self.cap:
            self.slots.clear()
            self.used = 0
            forget()
            miss = np.arange(len(h))
            own, first = np.unique(h, return_index=True)
        learn(miss[first])
        numbers = np.arange(self.used, self.used + len(own), dtype=np.int32)
        self.used += len(own)
        self.slots.put(own, numbers)
        out[miss] = numbers[np.searchsorted(own, h[miss])]
        return out


class Rows:
    """A growing array of equal rows."""

    def __init__(self):
        self.all: np.ndarray | None = None
        self.used = 0

    def add(self, rows: np.ndarray) -> None:
        need = self.used + len(rows)
        if self.all is None:
            self.all = np.empty((max(1 << 12, need), *rows.shape[1:]), rows.dtype)
        elif need > len(self.all):
            more = np.empty((max(need, len(self.all) * 3 // 2), *rows.shape[1:]), rows.dtype)
            more[: self.used] = self.all[: self.used]
            self.all = more
        self.all[self.used : need] = rows
        self.used = need

    def clear(self) -> None:
        self.all, self.used = None, 0


def raw_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class WordTable:
    """Rows derived from the letters of distinct words, remembered up to ``cap`` words per worker."""

    def __init__(self, derive: Callable[[list[str]], np.ndarray], cap: int = 150_000):
        self.derive, self.known, self.rows = derive, Known(cap), Rows()

    def index(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, place of each token's row)."""
        at = self.known.numbers(
            word_hashes(data, starts, ends), lambda new: self.rows.add(self.derive(letters_only(raw_words(data, starts[new], ends[new])))), self.rows.clear
        )
        return self.rows.all, at
