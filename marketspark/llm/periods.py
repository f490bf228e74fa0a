"""Maximal periodic runs of words inside a text, and the text with each run cut down to its first period.

A run is a stretch of words with smallest period q that no neighbour extends, at least ``least`` words and ``times``
periods long. For each q the places 0, 2q, 4q ... form a grid (harmonic in all, n log n places): a run of three periods
holds such a place i together with i + q, and the common extensions of the two to both sides give its borders. Extensions
come from a difference cover (``extension``), once for the words and once for the words reversed. Texts without two
places that agree in eight words on one side hold no run and are not sorted.

Defined cases: null and empty texts have no words and no run; repeated rows have the same result, each for itself; texts
of any length are handled whole (a text longer than a block is a block of its own, about 200 bytes of memory a word);
an empty table gives an empty result; only the two named columns are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extension import Extension
from .strings import word_codes
from .textblocks import blocks, spread, text_bytes, words

LEAST, TIMES = 24, 3
#: Grid places looked at together.
AT_ONCE = 1 << 20
SPLIT = r"[\x20\x09-\x0D]+"
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, top struct<start:long,length:long,period:long>, kept_text string"


def near(least: int, times: int) -> int:
    """Words that a pair (i, i + q) inside a run shares at least with its counterpart on one of the two sides."""
    return max(1, min((max(least, times * q) - q) // 2 for q in range(1, least + 1)))


def candidates(values: np.ndarray, base: np.ndarray, n: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places i and periods q, i and i + q equal together with ``near`` words on one side.

    ``values`` holds the rows (row r: n[r] values from base[r] on) with ``least`` values that equal nothing between and around them.
    """
    rows = np.flatnonzero(n >= max(least, times))
    count = n[rows] // times
    row, q = np.repeat(rows, count), spread(np.ones(len(rows), np.int64), count)
    pairs = ((n[row] - 1) // q + 1) // 2
    ends, lo, k = np.cumsum(pairs), 0, near(least, times)
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        if hi == lo + 1 and pairs[lo] > AT_ONCE:  # one long text, one period: its places in parts
            step = [np.arange(a, min(a + AT_ONCE, int(pairs[lo]))) for a in range(0, int(pairs[lo]), AT_ONCE)]
            parts = [(base[row[lo]] + 2 * q[lo] * s, np.full(len(s), q[lo])) for s in step]
        else:
            own = pairs[lo:hi]
            period = np.repeat(q[lo:hi], own)
            parts = [(np.repeat(base[row[lo:hi]], own) + 2 * period * spread(np.zeros(hi - lo, np.int64), own), period)]
        for i, period in parts:
            same = values[i] == values[i + period]
            i, period = i[same], period[same]
            after = before = np.arange(len(i))
            for t in range(1, k):
                after = after[values[i[after] + t] == values[i[after] + period[after] + t]]
            for t in range(1, k + 1):
                before = before[values[i[before] - t] == values[i[before] + period[before] - t]]
            hit = np.union1d(after, before)
            if len(hit):
                yield i[hit], period[hit]
        lo = hi


def runs_of(codes: np.ndarray, n: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """row, start, length, period of all runs of rows of words (``codes``: n[0] of the first row, then n[1] ...), by row, start, period."""
    gap, rows = max(least, times), len(n)
    base = np.cumsum(n) - n + gap * (np.arange(rows) + 1)
    values = np.zeros(len(codes) + gap * (rows + 1), np.int64)
    inside = np.zeros(len(values), bool)
    at = spread(base, n)
    inside[at] = True
    values[at] = codes
    values[~inside] = (int(codes.max()) + 1 if len(codes) else 0) + np.arange(gap * (rows + 1))
    found = list(candidates(values, base, n, least, times))
    empty = np.zeros(0, np.int64)
    if not found:
        return empty, empty, empty, empty
    i, q = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(base, i, "right") - 1
    # only rows with a candidate are sorted, side by side with a value of their own between them
    some = np.unique(row)
    place = np.cumsum(n[some] + 1) - n[some] - 1
    part = np.empty(int((n[some] + 1).sum()), np.int64)
    part[place + n[some]] = int(values.max()) + 1 + np.arange(len(some))
    part[spread(place, n[some])] = values[spread(base[some], n[some])]
    _, part = np.unique(part, return_inverse=True)
    own = np.searchsorted(some, row)
    i = i - base[row] + place[own]
    forward, backward = Extension(part), Extension(part[::-1])
    right = forward.common(i, i + q)
    left = backward.common(len(part) - i, len(part) - i - q)
    start, length = i - left - place[own], left + q + right
    good = length >= np.maximum(least, times * q)
    row, start, length, q = row[good], start[good], length[good], q[good]
    order = np.lexsort((q, length, start, row))
    row, start, length, q = (x[order] for x in (row, start, length, q))
    first = np.ones(len(row), bool)  # one stretch is found with multiples of its period, too
    first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    row, start, length, q = (x[first] for x in (row, start, length, q))
    order = np.lexsort((q, start, row))
    return tuple(x[order] for x in (row, start, length, q))


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Place of the run with the greatest exact length / period; ties: smallest start, then period (the given order)."""
    best = 0
    for k, (n, q) in enumerate(zip(length.tolist(), period.tolist())):
        if k and n * int(period[best]) > int(length[best]) * q:
            best = k
    return best


def _records(start, length, period) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs, top (the run of most periods), kept_text (words outside every run's tail, joined by one space) of each row."""
    if times < 3:
        raise ValueError("the grid finds runs of three periods and more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data_all, at_all = text_bytes(b.column(1))
            for lo, hi in blocks(at_all, 1 << 20):
                data, at = data_all[at_all[lo]:at_all[hi]], at_all[lo:hi + 1] - at_all[lo]
                rows = hi - lo
                begin, end, row = words(data, at)
                n = np.bincount(row, minlength=rows)
                base = np.cumsum(n) - n
                r, start, length, period = runs_of(word_codes(data, begin, end), n, least, times)
                cut = np.searchsorted(r, np.arange(rows + 1))
                step = np.zeros(len(begin) + 1, np.int64)
                np.add.at(step, base[r] + start + period, 1)
                np.add.at(step, base[r] + start + length, -1)
                keep = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                size = end[keep] - begin[keep] + 1
                held = data[np.minimum(spread(begin[keep], size), max(0, len(data) - 1))]
                held[np.cumsum(size) - 1] = 32
                stop = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(row[keep], weights=size, minlength=rows).astype(np.int64))))
                raw = held.tobytes()
                kept = [raw[a:max(a, z - 1)].decode("utf-8") for a, z in zip(stop[:-1].tolist(), stop[1:].tolist())]
                full = np.flatnonzero(np.diff(cut))
                best = np.zeros(rows, np.int64)
                for k in full.tolist():
                    best[k] = cut[k] + strongest(*(x[cut[k]:cut[k + 1]] for x in (start, length, period)))
                top = _records(*(x[best[full]] for x in (start, length, period)))
                where = np.full(rows, -1, np.int64)
                where[full] = np.arange(len(full))
                top = top.take(pa.array(where, mask=where < 0))
                all_runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _records(start, length, period))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, rows), pa.array(n, pa.int64()), all_runs, top, pa.array(kept, pa.string())],
                                                 ["id", "n_words", "runs", "top", "kept_text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def planted(id_col: Column, text_col: Column) -> Column:
    """The text with a period for a tenth of the ids: with h = crc32(id), g = h / 10 and n words, if h % 10 = 0 the words from
    a = g % n on repeat the p = 1 + (n - a) / (3 + g % 8) words there. Words are then joined by one space; other texts stay."""
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10).cast("long")
    w = F.filter(F.split(text_col, SPLIT), lambda x: x != "")

    def repeat(held: Column) -> Column:
        n = F.size(held).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(held, lambda x, i: F.when(i < a, x).otherwise(F.element_at(held, (a + (i - a) % p + 1).cast("int")))), " ")

    one = F.transform(F.array(w), lambda held: F.when(F.size(held) > 0, repeat(held)))  # the words are split once
    return F.when(h % 10 == 0, F.coalesce(F.element_at(one, 1), text_col)).otherwise(text_col)
