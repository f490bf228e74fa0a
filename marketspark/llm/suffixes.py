"""Repeated byte strings by suffix sorting: a multikey sort to a shallow depth, then blind tries for the deep groups.

The suffixes of the corpus are dealt by the minimiser of their first 100 bytes, so equal prefixes meet in one bucket, and
neighbouring suffixes with one minimiser travel as one string (with very many strings around one minimiser: each suffix to the bucket of its hash). Suffixes whose minimiser occurs once cannot repeat and stay
at home; equal strings are settled once, so only the strings around the edges of repeated passages are sorted suffix by
suffix. A bucket orders its suffixes by eight bytes at a time to 24 bytes; groups that are still equal are ordered by blind
tries: a trie node skips the bytes its suffixes share, found by comparing them with one leader, and branches by one byte.
All tries of a bucket grow together, level by level. Leaves at depth 100 are the repeated strings.

Defined cases: null counts as empty; a null id sorts before all others; documents with the same id are ordered by a hash of
their text, and exact repeats of a row have the row's result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minimisers import BLOCK, HOT, SENT, Prefix, bucket_of, buckets, dealt, finish, in_bitmap, minimiser_runs, seed_bitmaps
from .substrings import NONE, _merged, covered, smallest_first
from .tables import stored
from .strings import span_keys
from .textblocks import BYTE, U, binary, blocks, lists, runs, spread, text_bytes

LENGTH = 100
SEED = 24
#: Depth of the multikey sort: three keys of eight bytes.
SHALLOW = 24
#: Suffixes that one sort takes at a time (their keys take 104 bytes each); more only if one seed has more.
CHUNK_SUFFIXES = 250_000


def _strings(data: np.ndarray, at: np.ndarray, length: int, seed: int):
    """Super-k-mers of a block of bytes: prefix hashes, first start, number of starts, seed hash."""
    prefix = Prefix(BYTE[data])
    seeds = prefix.rolling(seed)
    size = np.diff(at)
    fits = np.zeros(len(data), bool)
    fits[spread(at[:-1], np.maximum(0, size - length + 1))] = True
    first, count, place = minimiser_runs(seeds, fits, length - seed + 1)
    return prefix, first, count, seeds[place] if len(place) else np.zeros(0, U)


def keys_of(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` bytes at each position as big-endian 64-bit keys (rows x keys), zero-filled."""
    wide = (length + 7) // 8 * 8
    held = np.zeros((len(at), wide), np.uint8)
    padded = np.concatenate((data, np.zeros(wide, np.uint8)))
    held[:, :length] = np.lib.stride_tricks.sliding_window_view(padded, length)[at]
    return held.view(">u8").astype(U)


def multikey_sort(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their first ``depth`` keys, and a mask of the places where a group begins.

    One key at a time, and only inside the groups that are still equal.
    """
    order = np.argsort(keys[:, 0], kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = keys[order, 0][1:] != keys[order, 0][:-1]
    for k in range(1, depth):
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        group = np.cumsum(head)[open_]
        key = keys[order[open_], k]
        by = np.lexsort((key, group))
        order[open_], key = order[open_][by], key[by]
        split = np.ones(len(open_), bool)
        split[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        head[open_] = split
    return order, head


def _common(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bytes that rows a and b share."""
    differ = keys[a] ^ keys[b]
    some = differ != 0
    word = np.argmax(some, 1)
    value = differ[np.arange(len(a)), word]
    byte = np.zeros(len(a), np.int64)
    for k in range(1, 8):
        byte += value < (U(1) << U(64 - 8 * k))
    return np.where(some.any(1), word * 8 + byte, keys.shape[1] * 8)


def blind_tries(keys: np.ndarray, order: np.ndarray, head: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Finishes the order of the groups that the shallow sort has left equal, to ``length`` bytes."""
    order, head = order.copy(), head.copy()
    done = np.zeros(len(order), bool)
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)) & ~done)
        if not len(open_):
            return order, head
        begins = head[open_]
        at = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        members = order[open_]
        shared = _common(keys, members, members[at][group])
        depth = np.minimum.reduceat(shared, at)[group]  # the node's bytes up to here are skipped
        leaf = depth >= length
        done[open_[leaf]] = True
        grow = ~leaf
        if not grow.any():
            continue
        where, group, members, depth = open_[grow], group[grow], members[grow], depth[grow]
        branch = (keys[members, depth // 8] >> (U(56) - U(8) * (depth % 8).astype(U))) & U(255)
        by = np.lexsort((branch, group))
        order[where] = members[by]
        branch = branch[by]
        split = np.ones(len(where), bool)
        split[1:] = (group[1:] != group[:-1]) | (branch[1:] != branch[:-1])
        head[where] = split


def equal_prefixes(data: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the suffixes at ``at`` by their first ``length`` bytes, and a mask of where equal ones begin."""
    keys = keys_of(data, at, length)
    order, head = multikey_sort(keys, max(1, min(shallow // 8, keys.shape[1])))
    return blind_tries(keys, order, head, length)


def later_copies(data: np.ndarray, at: np.ndarray, length: int = LENGTH, chunk: int = CHUNK_SUFFIXES) -> np.ndarray:
    """Which of the suffixes, given in document order, have an equal one before them (their places in ``at``).

    More suffixes than two chunks are dealt by a hash of their bytes first, so that a seed with very many different strings
    needs no more memory than others; equal ones stay together.
    """
    if len(at) > 2 * chunk:
        parts = -(-len(at) // chunk)
        of = (Prefix(BYTE[data]).spans(at, at + length) >> U(7)) % U(parts)
        found = [np.flatnonzero(of == U(k)) for k in range(parts)]
    else:
        found = [np.arange(len(at))]
    out = [np.zeros(0, np.int64)]
    for some in found:
        if len(some):
            order, head = equal_prefixes(data, at[some], length)
            first = np.flatnonzero(head)
            least = np.repeat(np.minimum.reduceat(order, first), np.diff(np.append(first, len(order))))
            out.append(some[order[order != least]])
    return np.concatenate(out)


def removed_starts(df: DataFrame, id_col: str, text_col: str, length: int, seed: int, hot: int = HOT) -> DataFrame:
    """(id, uid, start, n): runs of starts whose ``length`` bytes also start earlier in the corpus."""
    twice, often, again = seed_bitmaps(df, text_col, lambda data, at: _strings(data, at, length, seed), length, hot)
    parts = buckets(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(text).alias("uid"), text.alias("text"))
    names = ["part", "id", "uid", "start", "n", "seed", "held"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, uids = (b.column(i).to_numpy() for i in (0, 1))
            data_all, at_all = text_bytes(b.column(2))
            for lo, hi in blocks(at_all, BLOCK):
                data, at = data_all[at_all[lo]:at_all[hi]], at_all[lo:hi + 1] - at_all[lo]
                prefix, first, count, seed_hash = _strings(data, at, length, seed)
                go = np.flatnonzero(in_bitmap(twice.value, seed_hash))
                if not len(go):
                    continue
                first, count, seed_hash = dealt(prefix, first[go], count[go], seed_hash[go], length, often.value, again.value)
                if not len(first):
                    continue
                row = np.searchsorted(at, first, "right") - 1
                doc, uid, begin = ids[lo:hi][row], uids[lo:hi][row], first - at[row]
                size = count + length - 1
                by, head = smallest_first(span_keys(data, first, first + size), doc, uid, begin)
                copy = np.zeros(len(first), bool)
                copy[by] = (doc[by] != doc[by][head]) | (uid[by] != uid[by][head]) | (begin[by] != begin[by][head])
                if copy.any():
                    merged = _merged(doc[copy], uid[copy], begin[copy], count[copy])
                    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_of(seed_hash[:1], parts), pa.int32()), *map(one, merged), pa.array([[]], pa.list_(pa.int64())), pa.array([None], pa.binary())], names)
                send = np.flatnonzero(~copy)
                part = bucket_of(seed_hash[send], parts)
                everything = send[np.argsort(part, kind="stable")]
                parts_of = np.sort(part, kind="stable")
                for i, j in blocks(np.append(0, np.cumsum(size[everything])), SENT):
                    send = everything[i:j]
                    here, k = np.unique(parts_of[i:j], return_counts=True)
                    cut = np.concatenate(([0], np.cumsum(k)))
                    held = data[spread(first[send], size[send])]
                    ends = np.cumsum(size[send])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(here, pa.int32()), *(lists(np.ascontiguousarray(v[send]), cut) for v in (doc, uid, begin, count)),
                        lists(seed_hash[send].view(np.int64), cut), binary(held, np.concatenate(([0], ends[cut[1:] - 1])))], names)

    def judge(columns: list[list[np.ndarray]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, uid, begin, count, seeds = (np.concatenate(c) for c in columns)
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = count + length - 1
        place = np.cumsum(size) - size
        by, head = smallest_first(span_keys(data, place, place + size), doc, uid, begin)
        copy = np.zeros(len(by), bool)
        copy[by] = (doc[by] != doc[by][head]) | (uid[by] != uid[by][head]) | (begin[by] != begin[by][head])
        out = [(doc[copy], uid[copy], begin[copy], count[copy])]
        _, kind, many = np.unique(seeds[~copy], return_inverse=True, return_counts=True)
        own = np.flatnonzero(~copy)[many[kind] > 1]
        # equal suffixes have one seed: a chunk takes whole seeds
        kinds = kind[many[kind] > 1]
        by = np.argsort(kinds, kind="stable")
        own, kinds = own[by], kinds[by]
        chunk = (np.cumsum(count[own]) - count[own]) // CHUNK_SUFFIXES
        chunk = chunk[np.searchsorted(kinds, kinds)]
        for c in np.unique(chunk):
            part = own[chunk == c]
            # suffixes in the order of their documents, so that a smaller place in the list is an earlier start
            part = part[np.lexsort((begin[part], uid[part], doc[part]))]
            string = np.repeat(part, count[part])
            inner = spread(np.zeros(len(part), np.int64), count[part])
            gone = later_copies(data, place[string] + inner, length)
            out.append((doc[string[gone]], uid[string[gone]], begin[string[gone]] + inner[gone], np.ones(len(gone), np.int64)))
        doc, uid, begin, count = (np.concatenate(c) for c in zip(*out))
        if len(doc):
            yield pa.RecordBatch.from_arrays(_merged(doc, uid, begin, count), ["id", "uid", "start", "n"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, columns, texts = None, [[] for _ in range(5)], []
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i] for k in range(7)]
                values = [np.asarray(x.values) for x in row[1:6]]
                if not row[6].is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values[:4]], ["id", "uid", "start", "n"])
                    continue
                if row[0].as_py() != part and texts:
                    yield from judge(columns, texts)
                    columns, texts = [[] for _ in range(5)], []
                part = row[0].as_py()
                for held, v in zip(columns, values):
                    held.append(v)
                texts.append(row[6].as_py())
        if texts:
            yield from judge(columns, texts)

    sent = docs.mapInArrow(pack, "part int, id array<long>, uid array<long>, start array<long>, n array<long>, seed array<long>, held binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(settle, "id long, uid long, start long, n long")


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row of ``df``."""
    ranges = stored(removed_starts(df, id_col, text_col, length, seed, hot).select(F.when(F.col("id") != NONE, F.col("id")).alias("id"), "uid", "start", "n"), "removed-starts")

    def work(ids, texts, spans) -> Iterator[pa.RecordBatch]:
        data_all, at_all = text_bytes(texts)
        for lo, hi in blocks(at_all):
            data, at = data_all[at_all[lo]:at_all[hi]], at_all[lo:hi + 1] - at_all[lo]
            rows = hi - lo
            gone = covered(rows, at[:-1], spans.slice(lo, rows), length, len(data))
            edge, run = runs(gone)
            # a run that reaches into the next document is a run of each
            owner = np.searchsorted(at, edge, "right") - 1
            span = np.bincount(owner, minlength=rows)
            last = np.searchsorted(at, edge + run, "left") - 1
            for a, z in zip(owner[last > owner], last[last > owner]):
                inside = np.arange(a + 1, z + 1)
                span[inside] += at[inside + 1] > at[inside]
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[at[1:]] - sums[at[:-1]]
            kept = np.concatenate(([0], np.cumsum(np.diff(at) - removed)))
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, rows), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(span, pa.int64()), binary(data[~gone], kept)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return finish(df, id_col, text_col, ranges, work, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
