"""What the two substring operators share: minimisers, the bitmap of repeated seeds, buckets of packed strings, ranges.

A window's minimiser is the seed with the smallest hash inside it (the leftmost of equals), so equal windows have equal
minimisers at equal offsets, wherever they are. Seeds that occur once in the corpus cannot lie in a repeated window; a
bounded bitmap of the repeated ones keeps the other strings at home. A full bitmap only lets more strings travel.

A seed around which very many strings lie (a hot one) is no bucket: its windows travel one by one, each to the bucket of its own hash. Equal windows
have equal seeds, so they are dealt alike wherever they are; a second bounded bitmap tells the hot seeds, and a bit too many only deals more windows so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import MOST_BITS, PAGE, bits_for, bitmap_of, collect_bitmap, in_bitmap, shuffle_width
from .textblocks import BASE, INVERSE, POWER, U, _powers, blocks, spread, text_bytes

#: Bytes of text in one block here: the arrays of a block take about 100 times as much.
BLOCK = 1 << 20
#: Low bits that hold a position, so that a minimum also tells where it is.
PLACE = U((1 << 31) - 1)
SCRAMBLE = U(0x9FB21C651E98DF25)
#: Strings from which on a seed is hot.
HOT = 1 << 15
#: Bytes of strings that leave a block at once.
SENT = 8 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(POWER):
        return POWER[:n], INVERSE[:n]
    return _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)


class Prefix:
    """Hashes of any spans of a sequence of 64-bit values; with ``second`` values also a pair of hashes that tells short spans apart.

    The sums are polynomials, so the values must be strong hashes themselves (of words) where equality rests on the pair;
    over raw bytes they only deal spans to buckets.
    """

    def __init__(self, values: np.ndarray, second: np.ndarray | None = None):
        power, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * power[:len(values)], out=self.sums[1:])
        self.second = None if second is None else Prefix(second)

    def both(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(start, end), self.second.spans(start, end)

    def rolling(self, n: int) -> np.ndarray:
        """Hash of each span of ``n`` values."""
        m = len(self.sums) - n
        if m <= 0:
            return np.zeros(0, U)
        out = (self.sums[n:] - self.sums[:m]) * self.inverse[:m]
        out ^= out >> U(32)
        out *= SCRAMBLE
        return out

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.inverse[start]
        out ^= out >> U(32)
        out *= SCRAMBLE
        out ^= out >> U(29)
        return out * U(BASE) + (end - start).astype(U)


def minimiser_runs(seeds: np.ndarray, fits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and place of the seed of each run of consecutive windows with one minimiser.

    A window begins where ``fits`` is true and looks at ``width`` seeds from there.
    """
    if len(seeds) < width or not fits.any():
        e = np.zeros(0, np.int64)
        return e, e, e
    low = (seeds & ~PLACE) | np.arange(len(seeds), dtype=U)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    first = np.flatnonzero(fits[:len(low)])
    place = (low[first] & PLACE).astype(np.int64)
    head = np.ones(len(first), bool)
    head[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(head)
    return first[at], np.diff(np.append(at, len(first))), place[at]


def buckets(spark) -> int:
    """Buckets of strings: many more than tasks, so that one bucket, which a task holds at a time, stays small at any size."""
    return 16 * shuffle_width(spark)


def bucket_of(seeds: np.ndarray, count: int) -> np.ndarray:
    return ((seeds >> U(20)) % U(count)).astype(np.int64)


def repeated_seeds(df: DataFrame, text_col: str, seeds_of: Callable[[np.ndarray, np.ndarray], np.ndarray], hot: int | None = None):
    """Bitmap of the seeds that the corpus holds at least twice; with ``hot`` also that of those it holds so often. Blocks send each
    seed once or twice, packed by segment, and for the second bitmap the count of one that they hold more often.

    A seed travels as 32 bits beside its segment; two seeds that agree in all of them only set a bit too many.
    """
    spark = df.sparkSession
    segments = min(MOST_BITS // PAGE, 1 << (4 * shuffle_width(spark) - 1).bit_length())
    subs = max(1, 4 * shuffle_width(spark) // segments)  # a segment of the bitmap is counted in so many parts
    per, parts = U(MOST_BITS // segments), segments * subs

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            for lo, hi in blocks(at, 4 * BLOCK):
                got = []
                for i, j in blocks(at[lo:hi + 1] - at[lo], BLOCK // 2):
                    i, j = i + lo, j + lo
                    got.append(seeds_of(data[at[i]:at[j]], at[i:j + 1] - at[i]))
                found, times = np.unique(np.concatenate(got), return_counts=True)
                many = np.flatnonzero(times > 2) if hot else np.zeros(0, np.int64)
                rest = (times[many] - 2).astype(np.uint32)
                found = np.concatenate((found, found[times > 1], found[many]))
                part = (((found & U(MOST_BITS - 1)) // per) * U(subs) + (found >> U(40)) % U(subs)).astype(np.int64)
                low = U(int(per).bit_length() - 1)
                short = ((found & (per - U(1))) | ((found >> U(32)) << low)).astype(np.uint32)

                def packed(part: np.ndarray, *values: np.ndarray) -> list[list[bytes]]:
                    order, ends = np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
                    return [[v[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])] for v in (x[order] for x in values)]

                n = len(found) - len(many)
                (held,), (more, extra) = packed(part[:n], short[:n]), packed(part[n:], short[n:], rest)
                full = [k for k in range(parts) if held[k]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([v[k] for k in full], pa.binary()) for v in (held, more, extra))], ["part", "held", "more", "extra"])

    def told(part: int, seeds: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(int(per), np.uint8)
        bits[(seeds & np.uint32(per - U(1))).astype(np.int64)] = 1
        packed = np.packbits(bits, bitorder="little").reshape(-1, PAGE // 8)
        some = np.flatnonzero(packed.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some + int(part) // subs * len(packed) + 1 + shift, pa.int64()), pa.array([packed[k].tobytes() for k in some], pa.binary())], ["page", "held"])

    def pages(part: int, held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        seeds, more, extra = (np.frombuffer(b"".join(h), np.uint32) for h in held)
        seeds = np.sort(seeds)
        yield from told(part, seeds[1:][seeds[1:] == seeds[:-1]], 0)
        if hot:
            head = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1]))
            total = np.diff(np.append(head, len(seeds)))
            total += np.bincount(np.searchsorted(seeds[head], more), weights=extra, minlength=len(head)).astype(np.int64)
            yield from told(part, seeds[head[total >= hot]], MOST_BITS // PAGE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, [[], [], []]
        for b in batches:
            for p, *values in zip(*(b.column(k).to_pylist() for k in range(4))):
                if p != part and held[0]:
                    yield from pages(part, held)
                    held = [[], [], []]
                part = p
                for h, v in zip(held, values):
                    h.append(v)
        if held[0]:
            yield from pages(part, held)

    sent = df.select(F.col(text_col).cast("string")).mapInArrow(gather, "part int, held binary, more binary, extra binary")
    found = sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "page long, held binary")
    found = found.groupBy("page").agg(F.bitmap_or_agg("held").alias("held"))
    if hot is None:
        return spark.sparkContext.broadcast(collect_bitmap(found, MOST_BITS))
    both = collect_bitmap(found, 2 * MOST_BITS)
    return tuple(spark.sparkContext.broadcast(x.copy()) for x in (both[:MOST_BITS // 8], both[MOST_BITS // 8:]))


def seed_bitmaps(df: DataFrame, text_col: str, strings_of, window: int, hot: int) -> tuple[Broadcast, Broadcast, Broadcast]:
    """Bitmaps of the repeated seeds, of the hot ones, and of the repeated windows of hot seeds (a second pass, if there are hot ones).

    ``strings_of`` ends in prefix hashes, first windows, numbers of windows and seeds of a block.
    """
    twice, often = repeated_seeds(df, text_col, lambda data, at: strings_of(data, at)[-1], hot)
    if not often.value.any():
        return twice, often, often

    def singles(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        prefix, first, count, seed_hash = strings_of(data, at)[-4:]
        many = in_bitmap(often.value, seed_hash)
        first = spread(first[many], count[many])
        return prefix.spans(first, first + window)

    return twice, often, repeated_seeds(df, text_col, singles)


def dealt(prefix: Prefix, first: np.ndarray, count: np.ndarray, seed_hash: np.ndarray, window: int, hot: np.ndarray, again: np.ndarray):
    """Strings (first window, windows, seed) with those of hot seeds cut into single windows, each with its own hash as the seed; windows
    that occur once in the corpus stay at home."""
    many = in_bitmap(hot, seed_hash)
    if not many.any():
        return first, count, seed_hash
    single = spread(first[many], count[many])
    single = single[in_bitmap(again, prefix.spans(single, single + window))]
    first = np.concatenate((first[~many], single))
    order = np.argsort(first, kind="stable")
    count = np.concatenate((count[~many], np.ones(len(single), np.int64)))[order]
    return first[order], count, np.concatenate((seed_hash[~many], prefix.spans(single, single + window)))[order]


def ranges_by_document(ranges: DataFrame) -> DataFrame:
    """(id, uid, spans): all removed ranges of one document; no more than the document has windows."""
    return ranges.groupBy("id", "uid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def finish(df: DataFrame, id_col: str, text_col: str, ranges: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over every document with its ranges. Texts of documents without any range do not shuffle."""
    touched = bitmap_of(ranges, F.xxhash64("id", "uid"), bits_for(ranges.select("id", "uid").distinct().count()))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("uid"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text)).alias("h"))
    none = pa.array([[]], pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))

    def part(keep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = in_bitmap(touched.value, b.column(3).to_numpy())
                b = b.filter(pa.array(hit if keep else ~hit))
                if keep:
                    yield b.select(["id", "uid", "text"])
                else:
                    yield from work(b.column(0), b.column(2), none.take(pa.array(np.zeros(b.num_rows, np.int64))))
        return run

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from work(b.column(0), b.column(1), b.column(2))

    clean = docs.mapInArrow(part(False), schema)
    some = docs.mapInArrow(part(True), "id long, uid long, text string").join(
        ranges_by_document(ranges).select(F.col("id").alias("i"), F.col("uid").alias("u"), "spans"), F.col("id").eqNullSafe(F.col("i")) & (F.col("uid") == F.col("u")), "left")
    return clean.unionByName(some.select("id", "text", "spans").mapInArrow(whole, schema))
