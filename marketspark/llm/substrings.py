"""Repeated runs of words by super-k-mer partitioning.

Consecutive windows of 13 words that share a minimiser (a seed of five words) travel as one packed string to the bucket of
that seed (with very many strings around one seed: each window to the bucket of its hash), so every occurrence of a window meets there. The bucket sorts its windows and finds for each the smallest
document that has it. Copies inside one block of a task are settled there: only the smallest document's string travels, so
a text that holds a third of all rows sends each task's share once.

Defined cases: null counts as no words; rows with the same id never remove each other's words; a null id sorts before all
others; exactly repeated rows have the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minimisers import BLOCK, SENT, Prefix, bucket_of, buckets, dealt, finish, in_bitmap, minimiser_runs, seed_bitmaps
from .tables import stored
from .strings import span_keys
from .textblocks import U, binary, blocks, lists, spread, text_bytes, windows, words

WINDOW = 13
SEED = 5
NONE = -(1 << 63)
#: Bytes of the strings around one seed from which on it is hot, words taken for eight bytes: what a bucket holds in one task.
HOT_BYTES = 24 << 20
#: Bytes of strings of a task's blocks that leave it together, one row a bucket, and of one batch of these rows.
PACKED, PARCEL = 16 << 20, 2 << 20
#: Windows of a bucket that are sorted together.
SORTED = 1 << 18


def _strings(data, at, window, seed):
    """Words of a block and its super-k-mers: first word, windows, seed hash."""
    start, end, row = words(data, at)
    h, second = span_keys(data, start, end)
    prefix = Prefix(h, second)
    seeds = prefix.rolling(seed)
    fits = np.zeros(len(h), bool)
    m = len(h) - window + 1
    if m > 0:
        fits[:m] = row[window - 1:] == row[:m]
    first, count, place = minimiser_runs(seeds, fits, window - seed + 1)
    return start, end, row, prefix, first, count, seeds[place] if len(place) else np.zeros(0, U)


def smallest_first(identity: tuple[np.ndarray, np.ndarray], *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by identity (two keys) and then by ``order``; returns the sorting and, for each sorted row, where its group begins."""
    a, b = identity
    by = np.lexsort((*order[::-1], b, a))
    head = np.ones(len(by), bool)
    head[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    return by, np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))


def _merged(doc: np.ndarray, uid: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Ranges of windows, touching ones of a document joined."""
    by = np.lexsort((start, uid, doc))
    doc, uid, start, n = doc[by], uid[by], start[by], n[by]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(head)
    total = np.add.reduceat(n, at) if len(at) else n
    return [pa.array(doc[at]), pa.array(uid[at]), pa.array(start[at]), pa.array(total)]


def packed_strings(df: DataFrame, id_col: str, text_col: str, window: int, seed: int, hot: int | None = None) -> DataFrame:
    """(part, id, uid, start, n, held): strings of the windows that may repeat, one row for a bucket and what a task holds at a time. Rows
    without strings are ranges that are settled already."""
    hot = HOT_BYTES // (8 * (2 * window - seed)) if hot is None else hot
    twice, often, again = seed_bitmaps(df, text_col, lambda data, at: _strings(data, at, window, seed), window, hot)
    parts = buckets(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(text).alias("uid"), text.alias("text"))

    def parcels(kept: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The strings of many blocks, one row a bucket."""
        part, *values, size, held = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        order = np.argsort(part, kind="stable")
        at = np.cumsum(size) - size
        for i, j in blocks(np.append(0, np.cumsum(size[order])), PARCEL):
            some = order[i:j]
            here, k = np.unique(part[some], return_counts=True)
            cut = np.append(0, np.cumsum(k))
            yield pa.RecordBatch.from_arrays([
                pa.array(here, pa.int32()), *(lists(np.ascontiguousarray(v[some]), cut) for v in values), binary(held[spread(at[some], size[some])], np.append(0, np.cumsum(size[some]))[cut])],
                ["part", "id", "uid", "start", "n", "held"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weight = [], 0
        for b in batches:
            ids, uids = (b.column(i).to_numpy() for i in (0, 1))
            data_all, at_all = text_bytes(b.column(2))
            for lo, hi in blocks(at_all, BLOCK // 2):
                data, at = data_all[at_all[lo]:at_all[hi]], at_all[lo:hi + 1] - at_all[lo]
                start, end, row, prefix, first, count, seed_hash = _strings(data, at, window, seed)
                go = np.flatnonzero(in_bitmap(twice.value, seed_hash))
                if not len(go):
                    continue
                first, count, seed_hash = dealt(prefix, first[go], count[go], seed_hash[go], window, often.value, again.value)
                if not len(first):
                    continue
                word0 = np.searchsorted(row, np.arange(hi - lo))
                doc, uid = ids[lo:hi][row[first]], uids[lo:hi][row[first]]
                begin = first - word0[row[first]]
                by, head = smallest_first(prefix.both(first, first + count + window - 1), doc)
                copy = np.zeros(len(first), bool)
                copy[by] = doc[by] > doc[by][head]
                if copy.any():
                    merged = _merged(doc[copy], uid[copy], begin[copy], count[copy])
                    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_of(seed_hash[:1], parts), pa.int32()), *map(one, merged), pa.array([None], pa.binary())], ["part", "id", "uid", "start", "n", "held"])
                send = np.flatnonzero(~copy)
                # the strings, words joined by one space and strings ended by a line feed
                for i, j in blocks(np.append(0, np.cumsum(end[first[send] + count[send] + window - 2] - start[first[send]] + 1)), SENT // 2):
                    some = send[i:j]
                    length = count[some] + window - 1
                    word = spread(first[some], length)
                    size = end[word] - start[word] + 1
                    held = data[np.minimum(spread(start[word], size), len(data) - 1)].copy()
                    ends, stops = np.cumsum(size), np.cumsum(length)
                    held[ends - 1] = 32
                    held[ends[stops - 1] - 1] = 10
                    kept.append((bucket_of(seed_hash[some], parts).astype(np.int32), doc[some], uid[some], begin[some], count[some], np.diff(np.append(0, ends[stops - 1])), held))
                    weight += len(held)
                    if weight >= PACKED:
                        yield from parcels(kept)
                        kept, weight = [], 0
        if kept:
            yield from parcels(kept)

    return docs.mapInArrow(pack, "part int, id array<long>, uid array<long>, start array<long>, n array<long>, held binary")


def removed_windows(df: DataFrame, id_col: str, text_col: str, window: int, seed: int, hot: int | None = None) -> DataFrame:
    """(id, uid, start, n): runs of windows whose words also start in a document with a smaller id."""

    def judge(ids, uids, starts, texts) -> Iterator[pa.RecordBatch]:
        doc, uid, begin = (np.concatenate(x) for x in (ids, uids, starts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        line = np.flatnonzero(data == 10) + 1
        start, end, row = words(data, np.concatenate(([0], line)))
        h, second = span_keys(data, start, end)
        del start, end
        first, a = windows(h, row, window)
        _, c = windows(second, row, window)
        del h, second
        owner = row[first]
        at = begin[owner] + first - np.searchsorted(row, owner)
        parts = U(max(1, -(-len(a) // SORTED)))
        for k in range(int(parts)):  # equal windows have equal keys: a part at a time keeps the sort small
            own = np.arange(len(a)) if parts == 1 else np.flatnonzero((a >> U(9)) % parts == U(k))
            by = own[np.lexsort((doc[owner[own]], c[own], a[own]))]
            head = np.ones(len(by), bool)
            head[1:] = (a[by][1:] != a[by][:-1]) | (c[by][1:] != c[by][:-1])
            low = doc[owner[by]][np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
            gone = by[doc[owner[by]] > low]
            if len(gone):
                yield pa.RecordBatch.from_arrays(_merged(doc[owner[gone]], uid[owner[gone]], at[gone], np.ones(len(gone), np.int64)), ["id", "uid", "start", "n"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, uids, starts, texts = None, [], [], [], []
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i] for k in range(6)]
                values = [np.asarray(x.values) for x in row[1:5]]
                if not row[5].is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["id", "uid", "start", "n"])
                    continue
                if row[0].as_py() != part and ids:
                    yield from judge(ids, uids, starts, texts)
                    ids, uids, starts, texts = [], [], [], []
                part = row[0].as_py()
                ids.append(values[0])
                uids.append(values[1])
                starts.append(values[2])
                texts.append(row[5].as_py())
        if ids:
            yield from judge(ids, uids, starts, texts)

    sent = packed_strings(df, id_col, text_col, window, seed, hot)
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(settle, "id long, uid long, start long, n long")


def covered(rows: int, base: np.ndarray, spans: pa.Array, width: int, total: int) -> np.ndarray:
    """Mask over ``total`` items (row r begins at base[r]) of all that windows of ``width`` in the ranges cover."""
    step = np.zeros(total + 1, np.int64)
    flat = spans.flatten()
    if len(flat):
        count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
        first = np.repeat(base[:rows], count) + np.asarray(flat.field("start"))
        np.add.at(step, first, 1)
        np.add.at(step, np.minimum(first + np.asarray(flat.field("n")) + width - 1, total), -1)
    return np.cumsum(step[:-1]) > 0


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, hot: int | None = None) -> DataFrame:
    """id, n_words, n_removed, kept_text (the kept words joined by one space) of each row of ``df``."""
    ranges = stored(removed_windows(df, id_col, text_col, window, seed, hot).select(F.when(F.col("id") != NONE, F.col("id")).alias("id"), "uid", "start", "n"), "removed-windows")

    def work(ids, texts, spans) -> Iterator[pa.RecordBatch]:
        data_all, at_all = text_bytes(texts)
        for lo, hi in blocks(at_all, BLOCK // 2):
            data, at = data_all[at_all[lo]:at_all[hi]], at_all[lo:hi + 1] - at_all[lo]
            start, end, row = words(data, at)
            rows = hi - lo
            n = np.bincount(row, minlength=rows)
            base = np.cumsum(n) - n
            gone = covered(rows, base, spans.slice(lo, rows), window, len(start))
            keep = np.flatnonzero(~gone)
            size = end[keep] - start[keep] + 1
            held = data[np.minimum(spread(start[keep], size), max(0, len(data) - 1))].copy() if len(keep) else np.zeros(0, np.uint8)
            held[np.cumsum(size) - 1] = 32
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[keep], weights=size, minlength=rows).astype(np.int64))))
            raw = held.tobytes()
            kept = [raw[a:max(a, z - 1)].decode("utf-8") for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, rows), pa.array(n, pa.int64()), pa.array(np.bincount(row[gone], minlength=rows), pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return finish(df, id_col, text_col, ranges, work, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)

