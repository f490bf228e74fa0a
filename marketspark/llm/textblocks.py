"""Array helpers for the Arrow side of the text operators: bytes, words, word and window hashes of a block of rows.

Each helper works on one bounded block of rows that Spark hands to a task; nothing here holds a table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK = 2 << 20
#: Bytes that one run of prefix sums covers in :func:`span_hash`.
CHUNK = 1 << 18

U = np.uint64
#: The C library's call that returns free memory, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that close values differ in every bit."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
POWER = _powers(BASE, CHUNK + 1)
INVERSE = _powers(pow(BASE, -1, 1 << 64), CHUNK + 1)
#: One odd 64-bit value for each byte; the second table takes A-Z as a-z.
BYTE = mix(np.arange(1, 257, dtype=U)) | U(1)
BYTE_LOWER = BYTE[LOWER]
STEP = U(0xD6E8FEB86659FD93)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and where each row begins (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers live on and would keep it for later tasks."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def blocks(at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under ``limit``, or single longer rows."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
    release()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+`` in order."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = inside[at[:-1][full]]
    last[at[1:][full] - 1] = inside[at[1:][full] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of each byte span; starts and ends ascend. A span's hash depends on its bytes alone."""
    out, i, n = np.empty(len(start), U), 0, len(start)
    while i < n:
        base = start[i]
        j = int(np.searchsorted(end, base + CHUNK, "right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(table[data[base:end[i]]].tobytes())
            i += 1
            continue
        part = data[base:end[j - 1]]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(table[part] * POWER[:len(part)], out=sums[1:])
        s = start[i:j] - base
        out[i:j] = (sums[end[i:j] - base] - sums[s]) * INVERSE[s]
        i = j
    return mix(out)


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``n`` words inside one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total = np.zeros(m, U)
    for k in range(n):
        total *= STEP
        total += hashes[k:k + m]
    at = np.flatnonzero(row[n - 1:] == row[:m])
    return at, mix(total[at])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 ... (count[0] values), start[1] ...: the positions of many spans in one array."""
    count = np.asarray(count, np.int64)
    if not len(count) or not (total := int(count.sum())):
        return np.zeros(0, np.int64)
    step = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - step, count)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Arrow binary column whose rows are cut from one array of bytes."""
    data = np.ascontiguousarray(data).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def lists(values: np.ndarray, at: np.ndarray, kind=pa.int64()) -> pa.Array:
    """Arrow list column whose rows are cut from one array of values."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(at, np.int32)), pa.array(values, kind))
