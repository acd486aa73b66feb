"""A full-text index over word sequences: Burrows-Wheeler transform, backward search and sampled places.

All steps work on whole arrays, so thousands of patterns are searched at once.
"""

from __future__ import annotations

import io

import numpy as np

SAMPLE = 8


class FmIndex:
    """Index over documents given as word hashes. Word ids: 0 separates documents, known words from 1."""

    def __init__(self, words: np.ndarray, text: np.ndarray, starts: np.ndarray, bwt: np.ndarray, sampled: np.ndarray):
        self.words, self.text, self.starts, self.bwt, self.sampled = words, text, starts, bwt, sampled
        n = np.int64(len(bwt))
        self.n = n
        # Row i of the sorted keys is where the last-to-first mapping of bwt position (key mod n) leads.
        self.keys = np.sort(bwt.astype(np.int64) * n + np.arange(n, dtype=np.int64))
        self.marked = sampled >= 0

    @classmethod
    def build(cls, hashes: np.ndarray, lengths: np.ndarray) -> FmIndex:
        words = np.unique(hashes)
        ids = (np.searchsorted(words, hashes) + 1).astype(np.int32)
        ends = np.cumsum(lengths)
        text = np.zeros(len(hashes) + len(lengths) + 1, np.int32)
        starts = ends - lengths + np.arange(len(lengths)) + 1
        text[np.arange(len(hashes)) + 1 + np.repeat(np.arange(len(lengths)), lengths)] = ids
        order = suffix_order(text)
        bwt = text[order - 1]
        sampled = np.where(order % SAMPLE == 0, order, -1).astype(np.int32)
        return cls(words, text, starts.astype(np.int64), bwt, sampled)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, words=self.words, text=self.text, starts=self.starts, bwt=self.bwt, sampled=self.sampled)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> FmIndex:
        with np.load(io.BytesIO(blob)) as z:
            return cls(*(z[k] for k in ("words", "text", "starts", "bwt", "sampled")))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of hashes; -1 for words no document has."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, -1)

    def backward(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the patterns ids[first:last], each read from its end to its start."""
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.n, np.int64)
        at = last - 1
        live = np.flatnonzero(at >= first)
        while len(live):
            c = ids[at[live]]
            key = c * self.n
            low[live] = np.searchsorted(self.keys, key + low[live])
            high[live] = np.searchsorted(self.keys, key + high[live])
            at[live] -= 1
            empty = (c < 0) | (low[live] >= high[live])
            high[live[empty]] = low[live[empty]]
            live = live[~empty]
            live = live[at[live] >= first[live]]
        return low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows, by walking to the next sampled one."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[rows])
        while len(live):
            r = rows[live]
            rows[live] = np.searchsorted(self.keys, self.bwt[r].astype(np.int64) * self.n + r)
            walked[live] += 1
            live = live[~self.marked[rows[live]]]
        return self.sampled[rows] + walked


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks of the first 2^k words sort the next 2^(k+1)."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, text[order][1:] != text[order][:-1]])
    k = 1
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        k *= 2
        if k >= n:
            break
    return order


def within(a: np.ndarray, a0: np.ndarray, an: np.ndarray, b: np.ndarray, b0: np.ndarray, bn: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Word edits from a[a0:a0+an] to b[b0:b0+bn] for each pair, or -1 where more than ``most`` are needed.

    Furthest reaching diagonals, all pairs at once: after e edits, how far each diagonal matches.
    """
    found = np.full(len(a0), -1, np.int64)
    live = np.flatnonzero(np.abs(bn - an) <= most)
    if not len(live):
        return found
    top = int(most[live].max())
    width = 2 * top + 3
    far = np.full((len(live), width), -2, np.int64)
    gap = bn[live] - an[live]

    def slide(rows: np.ndarray, diagonal: int, x: np.ndarray) -> np.ndarray:
        y = x + diagonal
        who = live[rows]
        ok = np.flatnonzero((x >= 0) & (y >= 0) & (x < an[who]) & (y < bn[who]))
        while len(ok):
            same = a[a0[who[ok]] + x[ok]] == b[b0[who[ok]] + y[ok]]
            ok = ok[same]
            x[ok] += 1
            y[ok] += 1
            ok = ok[(x[ok] < an[who[ok]]) & (y[ok] < bn[who[ok]])]
        return x

    every = np.arange(len(live))
    for e in range(top + 1):
        if e:
            every = every[(found[live[every]] < 0) & (most[live[every]] >= e)]
            if not len(every):
                break
        new = np.full((len(every), width), -2, np.int64)
        for d in range(-e, e + 1):
            rows = np.flatnonzero(np.abs(gap[every] - d) <= most[live[every]] - e)
            if not len(rows):
                continue
            who, c = every[rows], d + top + 1
            if e == 0:
                x = np.zeros(len(rows), np.int64)
            else:
                # replaced, removed from a, inserted from b
                x = np.maximum(np.maximum(far[who, c] + 1, far[who, c + 1] + 1), far[who, c - 1])
                x = np.where(x < 0, -2, np.minimum(np.minimum(x, an[live[who]]), bn[live[who]] - d))
            new[rows, c] = slide(who, d, x)
        far[every] = new
        reach = far[every, gap[every] + top + 1] >= an[live[every]]
        hit = live[every[reach]]
        found[hit] = np.where(found[hit] < 0, e, found[hit])
    return found
