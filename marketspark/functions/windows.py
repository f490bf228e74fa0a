"""Rolling order statistics and windows whose length is a column, for one piece of a series at a time.

A window of k rows is a range of places.  Sums come from prefix sums, smallest and largest values from a
sparse table, and order statistics from a wavelet matrix over the ranks of the piece's values: the values are
divided bit by bit of their rank, and every range is followed down the bits at once.  So a row costs the same
whatever its window's length is, and no window is copied or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of requests; ``quantile``, ``tail_mean`` (mean of the values up to the quantile) take a share.
KINDS = ("mean", "sum", "std", "min", "max", "quantile", "tail_mean", "lag", "share_below")


class Wavelet:
    """Order statistics of any ranges of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        self.n = n = len(values)
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.levels = []
        for bit in range(int(n).bit_length() - 1, -1, -1):  # so that n itself, the rank of a bound above all values, has its bits
            zero = (rank >> bit & 1) == 0
            before = np.concatenate(([0], np.cumsum(zero)))
            rank = np.concatenate((rank[zero], rank[~zero]))
            self.levels.append((bit, before, np.concatenate(([0.0], np.cumsum(self.sorted[rank[:before[-1]]])))))

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range lo .. hi - 1."""
        rank = np.zeros(len(lo), np.int64)
        for bit, before, _ in self.levels:
            a, b = before[lo], before[hi]
            left = k < b - a
            rank += np.where(left, 0, 1 << bit)
            k = np.where(left, k, k - (b - a))
            lo, hi = np.where(left, a, lo - a + before[-1]), np.where(left, b, hi - b + before[-1])
        return self.sorted[rank]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, side: str = "left") -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the values of each range that are smaller than the bound (``side`` right: not larger)."""
        rank = np.searchsorted(self.sorted, bound, side)
        count, total = np.zeros(len(lo), np.int64), np.zeros(len(lo))
        for bit, before, sums in self.levels:
            a, b = before[lo], before[hi]
            right = (rank >> bit & 1) == 1
            count += np.where(right, b - a, 0)
            total += np.where(right, sums[b] - sums[a], 0.0)
            lo, hi = np.where(right, lo - a + before[-1], a), np.where(right, hi - b + before[-1], b)
        return count, total


class Ranges:
    """Windows over one column of a piece."""

    def __init__(self, values: np.ndarray, known: np.ndarray):
        self.values, self.known = np.where(known, values, 0.0), known
        self.holes = np.concatenate(([0], np.cumsum(~known)))
        self.tables: dict[str, list[np.ndarray]] = {}
        self._wavelet = self._sums = None

    @property
    def wavelet(self) -> Wavelet:
        if self._wavelet is None:
            self._wavelet = Wavelet(self.values)
        return self._wavelet

    def sums(self) -> tuple[float, np.ndarray, np.ndarray]:
        """A centre and the prefix sums of the distances from it and of their squares."""
        if self._sums is None:
            # whole numbers add up exactly as they are
            whole = (self.values == np.floor(self.values)).all() and np.abs(self.values).sum() < 1 << 52
            centre = 0.0 if whole or not self.known.any() else float(self.values[self.known].mean())
            d = np.where(self.known, self.values - centre, 0.0)
            self._sums = centre, np.concatenate(([0.0], np.cumsum(d))), np.concatenate(([0.0], np.cumsum(d * d)))
        return self._sums

    def extreme(self, name: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        fn = np.minimum if name == "min" else np.maximum
        if name not in self.tables:
            table, span = [self.values], 1
            while span * 2 <= len(self.values):
                table.append(fn(table[-1][:-span], table[-1][span:]))
                span *= 2
            self.tables[name] = table
        out = np.zeros(len(lo))
        level = np.frexp(np.maximum(hi - lo, 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            t = self.tables[name][k]
            out[own] = fn(t[lo[own]], t[hi[own] - (1 << k)])
        return out

    def roll(self, kind: str, k: np.ndarray, share: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Value of each row's window of the last k rows, and whether it is known (k rows, none of them null)."""
        n = len(self.values)
        at = np.arange(n)
        if kind == "lag":
            from_ = at - k
            good = (from_ >= 0) & (k >= 0)
            from_ = np.where(good, from_, 0)
            return self.values[from_], good & self.known[from_]
        if kind == "share_below":  # mean-rank share among up to k earlier values
            lo = np.maximum(0, at - k)
            seen = at - lo - (self.holes[at] - self.holes[lo])
            # nulls stand in as 0: take them out of the counts again
            holes = self.holes[at] - self.holes[lo]
            less, _ = self.wavelet.below(lo, at, self.values, "left")
            most, _ = self.wavelet.below(lo, at, self.values, "right")
            less, most = less - holes * (self.values > 0), most - holes * (self.values >= 0)
            good = self.known & (seen > 0)
            return (less + most + (most > less)) * 0.5 / np.maximum(seen, 1), good
        lo, hi = at + 1 - k, at + 1
        good = (k > 0) & (lo >= 0)
        lo = np.where(good, lo, at)
        good &= self.holes[hi] == self.holes[lo]
        size = hi - lo
        if kind in ("min", "max"):
            return self.extreme(kind, lo, hi), good
        if kind in ("mean", "sum", "std"):
            centre, one, two = self.sums()
            s = one[hi] - one[lo]
            if kind == "mean":
                return centre + s / size, good
            if kind == "sum":
                return centre * size + s, good
            flat = self.extreme("min", lo, hi) == self.extreme("max", lo, hi)
            var = np.maximum(two[hi] - two[lo] - s * s / size, 0.0) / np.maximum(size - 1, 1)
            return np.where(flat, 0.0, np.sqrt(var)), good & (size > 1)
        place = share * (size - 1)
        a = self.wavelet.kth(lo, hi, np.floor(place).astype(np.int64))
        z = self.wavelet.kth(lo, hi, np.ceil(place).astype(np.int64))
        if kind == "quantile":
            return a + (z - a) * (place - np.floor(place)), good
        count, total = self.wavelet.below(lo, hi, a, "right")  # nothing lies between a and the quantile
        return total / np.maximum(count, 1), good


def piece_windows(requests: Sequence[tuple[str, str, str, str, float | None]], pos: str, rows: int):
    """Function over the Arrow table of one piece that adds a column per request (name, kind, column, column of the length, share)."""

    def run(table: pa.Table) -> pa.Table:
        place = table.column(pos).to_numpy()
        if (np.diff(place) < 0).any():
            table = table.take(pa.array(np.argsort(place, kind="stable")))
            place = table.column(pos).to_numpy()
        held: dict[str, Ranges] = {}
        core = np.asarray(table.column("_core"))
        for name, kind, column, length, share in requests:
            if column not in held:
                v = pc.cast(table.column(column), pa.float64())
                known = ~np.asarray(v.is_null())
                held[column] = Ranges(np.asarray(v.fill_null(0.0), float), known)
            k = np.asarray(table.column(length).fill_null(-1), np.int64)
            cut = k > np.arange(len(k)) + 1 if kind != "lag" else k > np.arange(len(k))
            if len(place) and place[0] > 0 and kind != "share_below" and (cut & core).any():
                raise ValueError(f"a window is longer than the halo of its piece: {int(k[cut & core].max())}")
            value, good = held[column].roll(kind, k, share)
            table = table.append_column(name, pa.array(value, pa.float64(), mask=~good))
        return table

    return run
