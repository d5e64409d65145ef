"""A compressed full-text index over integer symbols: BWT ranks, backward search, locate.

The text is a run of documents, each ended by its own separator (symbol 0). For each symbol the sorted
places of the BWT that hold it are kept; rank(c, i) is a binary search among them, and differences
of these places compress well, which is what the serialised form stores, with a sample of the suffix
array. All searches work on arrays of patterns at once.
"""

from __future__ import annotations

import io
import zlib

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray, cyclic: bool = False) -> np.ndarray:
    """Suffixes (or rotations) in order, by prefix doubling."""
    n = len(text)
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.roll(rank, -k) if cyclic else np.full(n, -1, np.int64)
        if not cyclic:
            second[: n - k] = rank[k:] if k < n else second[: n - k]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank, k = new, 2 * k
        if k >= n or rank.max(initial=0) == n - 1:
            return order if rank.max(initial=0) == n - 1 else np.argsort(rank, kind="stable")


class Index:
    """Index of documents given as arrays of 64-bit symbols."""

    def __init__(self, vocabulary: np.ndarray, first: np.ndarray, places: np.ndarray, samples: np.ndarray, starts: np.ndarray) -> None:
        self.vocabulary, self.first, self.places, self.samples, self.starts = vocabulary, first, places, samples, starts
        self.n = len(places)
        self.symbol_of = np.empty(self.n, np.int64)  # BWT: the symbol at each place
        self.symbol_of[places] = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (self.n + 1) + places
        self.lf = np.empty(self.n, np.int64)
        self.lf[places] = np.arange(self.n)

    @classmethod
    def build(cls, documents: list[np.ndarray]) -> Index:
        sizes = np.array([len(d) for d in documents], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        vocabulary = np.unique(np.concatenate(documents)) if len(documents) else np.empty(0, np.int64)
        text = np.zeros(starts[-1], np.int64)
        for d, s in zip(documents, starts):
            text[s : s + len(d)] = np.searchsorted(vocabulary, d) + 1
        order = suffix_array(text, cyclic=True)  # rotations: so a step back over a separator holds too; documents are distinct, so no two are equal
        bwt = text[order - 1]
        places = np.argsort(bwt, kind="stable")
        first = np.searchsorted(bwt[places], np.arange(len(vocabulary) + 2))
        keep = (order % SAMPLE == 0) | np.isin(order, starts)  # document starts too: no walk crosses a separator
        samples = np.full(len(text), -1, np.int64)
        samples[keep] = order[keep]
        return cls(vocabulary, first, places, samples, starts)

    def dump(self) -> bytes:
        step = self.places.copy()
        step[1:] -= self.places[:-1]
        at = np.flatnonzero(self.samples >= 0)
        out = io.BytesIO()
        np.savez(out, v=self.vocabulary, f=self.first.astype(np.int32), p=step.astype(np.int32), a=at.astype(np.int32), s=self.samples[at].astype(np.int32), d=self.starts.astype(np.int32))
        return zlib.compress(out.getvalue(), 1)

    @classmethod
    def load(cls, blob: bytes) -> Index:
        z = np.load(io.BytesIO(zlib.decompress(blob)))
        places = np.cumsum(z["p"].astype(np.int64))
        samples = np.full(len(places), -1, np.int64)
        samples[z["a"]] = z["s"]
        return cls(z["v"], z["f"].astype(np.int64), places, samples, z["d"].astype(np.int64))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of the index for 64-bit symbols of a pattern; -1 for those that it doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def interval(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of one-symbol patterns; empty for unknown symbols. 0 is the separator."""
        known = np.maximum(symbol, 0)
        return np.where(symbol >= 0, self.first[known], 0), np.where(symbol >= 0, self.first[known + 1], 0)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of symbol + pattern; empty for unknown symbols. 0 is the separator."""
        known = np.maximum(symbol, 0)
        a, b = (np.searchsorted(self.keys, known * (self.n + 1) + x) for x in (lo, hi))
        return np.where(symbol >= 0, a, 0), np.where(symbol >= 0, b, 0)

    def ends(self) -> np.ndarray:
        """The row of each document's separator: from there `back` reads the document from its end."""
        rows = np.arange(self.first[1])
        out = np.empty(len(rows), np.int64)
        out[self.documents(self.locate(rows))[0]] = rows
        return out

    def back(self, rows: np.ndarray) -> np.ndarray:
        """One step back in the text: the row of the suffix that begins one symbol earlier."""
        return self.lf[rows]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by LF steps to the next sample."""
        out, rows, walked = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            got = self.samples[rows]
            done = got >= 0
            out[todo[done]] = got[done] + walked
            todo, rows, walked = todo[~done], self.lf[rows[~done]], walked + 1
        return out

    def documents(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and offsets of text positions."""
        d = np.searchsorted(self.starts, positions, side="right") - 1
        return d, positions - self.starts[d]
