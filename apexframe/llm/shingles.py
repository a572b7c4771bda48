"""Hashed words and shingles of whole Arrow text batches, without a Python loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from apexframe.llm.arrow import raw_text

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_UNPOWERS = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose output bits look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _UNPOWERS
    if len(_POWERS) < n:
        n = max(n, 1 << 16, 2 * len(_POWERS))
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS, _UNPOWERS = np.cumprod(up), np.cumprod(down)
    return _POWERS, _UNPOWERS


class Words:
    """Words of a batch of texts: maximal runs without ASCII white space.

    ``start`` and ``end`` are byte places in the joined batch, ``first`` holds
    the n + 1 numbers of the rows' first words, ``hash`` a 64-bit hash of each.
    """

    def __init__(self, texts: pa.StringArray) -> None:
        self.data, self.offsets = raw_text(texts)
        size = len(self.data)
        inside = np.zeros(size + 2, np.int8)
        inside[1:-1] = ~SPACE[self.data]
        change = np.diff(inside)
        # A row's end also ends a word: cut at offsets inside a run.
        cuts = self.offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < size)])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.start, self.end = starts, ends
        self.first = np.searchsorted(starts, self.offsets)
        self._prefix: np.ndarray | None = None

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans; equal bytes have equal hashes."""
        up, down = _powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        return self.span_hashes(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words in a row, and n + 1 row places.

        With ``whole_short`` a text of fewer words, but one at least, has one
        window of all its words.
        """
        words, n = self.hash, self.counts()
        joined = np.zeros(len(words), np.uint64)
        for k in range(size):
            moved = np.zeros(len(words), np.uint64)
            moved[: len(words) - k] = words[k:] if k else words
            joined += mix(moved + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        joined = mix(joined)
        per_row = np.maximum(n - size + 1, 0)
        short = (n > 0) & (n < size) & whole_short
        if whole_short and short.any():
            for row in np.flatnonzero(short):
                a, b = self.first[row], self.first[row + 1]
                place = np.arange(b - a, dtype=np.uint64)
                total = mix(words[a:b] + place + np.uint64(1)) * (np.uint64(2) * place + np.uint64(3))
                joined[a] = mix(total.sum(keepdims=True) ^ np.uint64(b - a))[0]
            per_row = np.where(short, 1, per_row)
        places = np.concatenate([[0], np.cumsum(per_row)])
        within = np.arange(places[-1]) - np.repeat(places[:-1], per_row)
        return joined[np.repeat(self.first[:-1], per_row) + within], places


def unique_per_row(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and their n + 1 places."""
    rows = np.repeat(np.arange(len(places) - 1), np.diff(places))
    order = np.lexsort((hashes, rows))
    hashes = hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    counts = np.bincount(rows[keep], minlength=len(places) - 1)
    return hashes[keep], np.concatenate([[0], np.cumsum(counts)])
