"""Index along the Hilbert curve of points on a grid of any number of dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``points`` (rows x dimensions, integers under 2**bits); dimensions * bits <= 62.

    The coordinates are turned into the transposed Gray code of the index, plane by plane, for all points at once.
    """
    x = [np.asarray(c, np.int64).copy() for c in np.asarray(points).T]
    dims = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(dims):
            hit = (x[i] & plane) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        plane >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        turn = np.where(x[-1] & plane, turn ^ (plane - 1), turn)
        plane >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> b) & 1)
    return out
