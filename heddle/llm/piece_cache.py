"""Encode many texts through a tokenizer once per distinct piece.

A tokenizer that never joins characters across certain boundaries may be run on the pieces between
them. ``PieceCache`` keeps the ids of the pieces met so far in flat arrays (bounded, then emptied),
so that a task pays for the tokenizer once per distinct piece and for NumPy gathers otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pandas as pd

from heddle.llm.textcore import ragged, span_hashes

#: Distinct pieces held by one Python worker before the cache is emptied (about 55 bytes each).
CACHE_PIECES = 1_000_000


class PieceCache:
    """Ids of pieces in flat arrays, found by binary search in their sorted hashes.

    A piece is found by one 64-bit hash and compared by a second, independent one. Where two pieces agree in the
    first only, their batch is encoded without the cache.
    """

    def __init__(self, encode: Callable[[Sequence[str]], Sequence[Sequence[int]]], limit: int = CACHE_PIECES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.at, self.n, self.other = (np.zeros(1 << 14, dtype=t) for t in (np.int64, np.int32, np.uint64))
        self.used = 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys stand or would stand in the sorted ones, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), dtype=bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.encode(pieces)
        counts = np.fromiter(map(len, rows), dtype=np.int32, count=len(rows))
        return np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(counts.sum())), counts

    def _add(self, keys: np.ndarray, other: np.ndarray, at: np.ndarray, pieces: list[str]) -> None:
        """Encode the pieces of sorted new keys; ``at`` is where these go."""
        flat, counts = self._encoded(pieces)
        base, n = len(self.keys), len(counts)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + n > len(self.at):
            self.at, self.n, self.other = (np.concatenate([a, np.zeros_like(a)]) for a in (self.at, self.n, self.other))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[base : base + n] = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.n[base : base + n], self.other[base : base + n] = counts, other
        self.used += len(flat)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, np.arange(base, base + n, dtype=np.int32))

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the spans one after another, and how many each span has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = buf.tobytes()
        texts = lambda at: [raw[s:e].decode("utf-8") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        codes, distinct = pd.factorize(span_hashes(buf, starts, ends))
        other = span_hashes(buf, starts, ends, which=1)
        first = np.empty(len(distinct), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.keys) + len(distinct) > self.limit:
            self._clear()
        at, there = self._find(distinct)
        if not there.all():
            new = np.flatnonzero(~there)
            new = new[np.argsort(distinct[new])]
            self._add(distinct[new], other[first[new]], at[new], texts(first[new]))
            at, _ = self._find(distinct)
        where = self.place[at][codes]
        if (self.other[where] != other).any():
            flat, counts = self._encoded(texts(slice(None)))
            return flat, counts.astype(np.int64)
        counts = self.n[where].astype(np.int64)
        return self.flat[ragged(self.at[where], counts)], counts
