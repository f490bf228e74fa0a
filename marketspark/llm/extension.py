"""Longest common extensions of two places of a sequence, by sorting only the suffixes at a difference cover.

A difference cover modulo v is a set D of residues such that every residue is a difference of two of them. So for any two
places i, j there is a shift under v that takes both to places whose residue lies in D. Only suffixes at such places are
sorted; a query compares the few words before the shift directly and reads the rest as a range minimum over the common
prefixes of neighbours in the sorted order (a sparse table).
"""

from __future__ import annotations

import numpy as np

#: Perfect difference covers by modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def shifts(v: int, cover: tuple[int, ...]) -> np.ndarray:
    """For each difference d a residue x of the cover with x + d in the cover as well."""
    out = np.full(v, -1, np.int64)
    for x in cover:
        for y in cover:
            out[(y - x) % v] = x
    if (out < 0).any():
        raise ValueError("not a difference cover")
    return out


class Extension:
    """Common extensions to the right over ``values`` (whole numbers from 0); past the end nothing is equal."""

    def __init__(self, values: np.ndarray, v: int = 31):
        self.v, cover = v, COVERS[v]
        self.shift = shifts(v, cover)
        self.n = n = len(values)
        # after the end v places that equal nothing: every one has a value of its own
        self.values = np.concatenate((values, (values.max() if n else 0) + 1 + np.arange(2 * v))).astype(np.int64)
        chosen = np.zeros(v, bool)
        chosen[list(cover)] = True
        self.place = np.flatnonzero(chosen[np.arange(n) % v])
        self.index = np.full(n + 1, -1, np.int64)
        self.index[self.place] = np.arange(len(self.place))
        self._sort()
        self._prefixes()

    def _refine(self, rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Splits the groups of equal ranks (a rank is the place of its group's first) by ``key``; returns what is still tied."""
        order = active[np.lexsort((key, rank[active]))]
        k = np.empty(len(rank), np.int64)
        k[active] = key
        r, k = rank[order], k[order]
        group = np.append(True, r[1:] != r[:-1]) if len(order) else np.zeros(0, bool)
        head = group.copy()
        head[1:] |= k[1:] != k[:-1]
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(group, at, 0))
        mine = np.maximum.accumulate(np.where(head, at, 0))
        rank[order] = r + mine - first
        size = np.diff(np.append(np.flatnonzero(head), len(order)))
        return order[np.repeat(size > 1, size)]

    def _sort(self) -> None:
        m, v = len(self.place), self.v
        rank, active = np.zeros(m, np.int64), np.arange(m)
        base = int(self.values.max()) + 1
        for k in range(0, v, 2):  # the first v words, two at a time; only ties go on
            if not len(active):
                break
            at = self.place[active] + k
            second = self.values[at + 1] if k + 1 < v else 0
            active = self._refine(rank, active, self.values[at] * base + second)
        self.ranks = [(v, rank.copy())]
        width = v
        while len(active):  # prefix doubling over samples of one residue
            far = self.place[active] + width
            key = np.where(far < self.n, rank[self.index[np.minimum(far, self.n)]], -far)
            active = self._refine(rank, active, key)
            width *= 2
            self.ranks.append((width, rank.copy()))
        self.rank = rank

    def _prefixes(self) -> None:
        """Common prefix of each sorted sample with the one before it, and the sparse table of their minima."""
        order = np.empty(len(self.place), np.int64)
        order[self.rank] = self.place
        x, y = order[:-1].copy(), order[1:].copy()
        total = np.zeros(len(x), np.int64)
        for width, rank in reversed(self.ranks):
            inside = np.flatnonzero((x < self.n) & (y < self.n))
            equal = inside[rank[self.index[x[inside]]] == rank[self.index[y[inside]]]]
            for a in (x, y, total):
                a[equal] += width
        total += self._direct(x, y, np.full(len(x), self.v))
        low = np.concatenate((np.zeros(min(1, len(order)), np.int64), total)).astype(np.int32)
        self.table, span = [low], 1
        while span * 2 <= len(low):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` (at most v) of them looked at."""
        out, live, t = np.zeros(len(i), np.int64), np.flatnonzero((most > 0) & (i < self.n) & (j < self.n)), 0
        while len(live):
            live = live[self.values[i[live] + t] == self.values[j[live] + t]]
            t += 1
            out[live] = t
            live = live[most[live] > t]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of places i and j (different ones), each."""
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        before = (self.shift[(j - i) % self.v] - i) % self.v
        out = self._direct(i, j, before)
        go = np.flatnonzero((out == before) & (i + before < self.n) & (j + before < self.n))
        if len(go):
            a, b = self.rank[self.index[i[go] + before[go]]], self.rank[self.index[j[go] + before[go]]]
            lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
            level = np.frexp((hi - lo + 1).astype(float))[1] - 1
            least = np.empty(len(go), np.int64)
            for k in np.unique(level):
                own = np.flatnonzero(level == k)
                least[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << k) + 1])
            out[go] += least
        return out
