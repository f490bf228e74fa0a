"""Identity of byte spans without collisions that matter: strong keys of many spans at once, exact codes of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .textblocks import U, mix, spread

#: Spans longer than this are hashed one by one.
LONG = 2048
#: Spans hashed together, so that intermediate arrays stay small.
PART = 1 << 16
ONE, TWO, STEP_ONE, STEP_TWO = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)
LEFT = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each byte span, which together are its identity (128 bits). They depend on its bytes alone.

    Eight bytes at a time enter two chains of a bijective finaliser, so no algebra of the bytes (as in polynomials
    modulo a power of two) makes different spans equal.
    """
    n = len(start)
    a, b = np.empty(n, U), np.empty(n, U)
    for i in range(0, n, PART):
        j = min(n, i + PART)
        a[i:j], b[i:j] = _keys(data, np.asarray(start[i:j], np.int64), np.asarray(end[i:j], np.int64))
    return a, b


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = end - start
    a, b = mix(size.astype(U) * STEP_ONE ^ ONE), mix(size.astype(U) * STEP_TWO ^ TWO)
    low, high = int(start.min()), int(end.max())
    held = data[low:high + 8]
    if len(held) < high - low + 8:
        held = np.concatenate((held, np.zeros(high - low + 8 - len(held), np.uint8)))
    held = np.ascontiguousarray(held)
    word = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
    start = start - low
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        chunk = word[start[live] + at] & LEFT[np.minimum(left, 8)]
        a[live] = mix(a[live] ^ chunk * STEP_ONE)
        b[live] = mix((b[live] + chunk) * STEP_TWO ^ TWO)
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(size > LONG):
        whole = xxhash.xxh3_128_intdigest(held[start[k]:start[k] + size[k]].tobytes())
        a[k], b[k] = whole & ((1 << 64) - 1), whole >> 64
    return a, b


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal codes for equal spans and only for them: a dictionary of the bytes themselves, numbered by first occurrence."""
    if not len(start):
        return np.zeros(0, np.int64)
    size = np.asarray(end - start, np.int64)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    held = np.ascontiguousarray(data[spread(start, size)])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)
