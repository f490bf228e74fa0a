"""Shards along a Hilbert curve of several metadata dimensions.

Language, source, size and id are quantised at their own quantiles, the rows are range-sorted by the curve index of the
quantised point, and the sorted run is cut where the bytes before it pass each shard's share (law ``bytes``). Files of one
shard then cover a small box of every dimension, so min/max statistics prune on any of them.

Equal texts take the metadata of their smallest member, lie together on the curve, and stay in one shard; cuts move to the
borders of groups. A group that takes more than ``together`` of a shard would unbalance its neighbours: such groups (no more
than shards / together of them) are dealt first, the largest to the emptiest shard, and the run along the curve then fills
the shards up to one level. Only a group that alone is larger than a shard is cut like other rows.

Defined cases: null text has no bytes; null metadata sorts first; rows with a null id take part; an empty table gives no
rows; rows that repeat each keep a slot of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_index
from .tables import running_positions, stored

SHARDS = 40
#: Bits of each quantised dimension.
BITS = 5
#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: Part of a shard from which on a group of equal texts gets a shard before the run along the curve is cut.
TOGETHER = 0.05
DIMENSIONS = ("__lang", "__source", "__bytes", "__first")


def _rank(name: str):
    """The first seven bytes of a string as a number that sorts like the string."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(name).cast("string"), "utf-8")), 1, 14), 14, "0"), 16, 10).cast("long")


def _on_curve(df: DataFrame) -> DataFrame:
    """Adds ``__curve``: the Hilbert index of the dimensions, each cut at its quantiles."""
    parts = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = [np.unique(np.array(c if c is not None else [], np.int64)) for c in
            df.agg(*(F.percentile_approx(d, F.lit(parts), 2000).alias(d) for d in DIMENSIONS)).first()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            point = np.empty((b.num_rows, len(DIMENSIONS)), np.int64)
            for i, d in enumerate(DIMENSIONS):
                col = b.column(b.schema.get_field_index(d))
                value = col.fill_null(0).to_numpy(zero_copy_only=False)
                point[:, i] = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts[i], value, "right"))
            yield b.append_column("__curve", pa.array(hilbert_index(point, BITS), pa.int64()))

    return df.mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", __curve long")


def homes(groups: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """A shard for each large group (text hash, bytes), the largest first to the emptiest shard; and the bytes that each shard then has."""
    load = [(0, k) for k in range(shards)]
    home = {}
    for text, own in sorted(groups, key=lambda g: (-g[1], g[0])):
        held, k = heapq.heappop(load)
        home[text] = k
        heapq.heappush(load, (held + own, k))
    return home, [held for held, _ in sorted(load, key=lambda x: x[1])]


def run_ends(load: list[int], total: int) -> list[float]:
    """Where the run of the other rows, laid out by bytes, is cut: every shard is filled up to one level."""
    left, level = total - sum(load), 0.0
    held = sorted(load)
    for k in range(1, len(held) + 1):  # the level if the k emptiest shards take the run
        level = (left + sum(held[:k])) / k
        if k == len(held) or level <= held[k]:
            break
    return np.cumsum([max(0.0, level - x) for x in load]).tolist()


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source", together: float = TOGETHER) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and the curve index of each row of ``df``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("__id"), F.octet_length(text).cast("long").alias("__bytes"), F.crc32(text).alias("__crc"),
        F.xxhash64(text).alias("__text"), _rank(lang_col).alias("__lang"), _rank(source_col).alias("__source"))
    # written tables, so that the joins with them can split a hot text over many tasks
    groups = stored(rows.groupBy("__text").agg(
        F.count("*").alias("__n"), F.min("__id").alias("__first"), F.min("__lang").alias("__glang"), F.min("__source").alias("__gsource"),
        F.max("__bytes").alias("__each")).filter("__n > 1"), "shard-groups")
    total = rows.agg(F.sum(F.col("__bytes") + OVERHEAD)).first()[0] or 1
    own = F.col("__n") * (F.col("__each") + OVERHEAD)
    # at most shards / together groups
    large = groups.filter((own > together * total / shards) & (own <= total / shards)).select("__text", own.alias("own")).collect()
    home, load = homes([(r["__text"], r["own"]) for r in large], shards)
    ends = run_ends(load, total)
    homes_table = df.sparkSession.createDataFrame([(t, int(k)) for t, k in home.items()], "__text2 long, __home int")
    rows = rows.join(groups, "__text", "left").select(
        "__id", "__bytes", "__crc", "__text", F.coalesce("__n", F.lit(1)).alias("__n"), F.coalesce("__first", "__id").alias("__first"),
        F.when(F.col("__n").isNull(), F.col("__lang")).otherwise(F.col("__glang")).alias("__lang"),
        F.when(F.col("__n").isNull(), F.col("__source")).otherwise(F.col("__gsource")).alias("__source"))
    rows = rows.join(F.broadcast(homes_table), F.col("__text") == F.col("__text2"), "left").drop("__text2")
    narrow = _on_curve(rows).select(F.coalesce("__home", F.lit(-1)).alias("__home"), "__curve", "__text", "__id", "__crc", "__n", (F.col("__bytes") + OVERHEAD).alias("__size"))
    # the run along the curve first, then the groups with a home of their own
    placed = running_positions(narrow, ["__home", "__curve", "__text", "__id"], {"__at": "__size", "__index": None})
    # a group's first byte; equal texts have equal sizes and lie together
    begins = stored(placed.filter("__n > 1 AND __home < 0").groupBy("__curve", "__text").agg(F.min("__at").alias("__begin")), "shard-begins")
    whole = (F.col("__n") > 1) & (F.col("__n") * F.col("__size") <= F.lit(total / shards))
    middle = F.when(whole, F.col("__begin") + F.col("__n") * F.col("__size") / 2).otherwise(F.col("__at") + F.col("__size") / 2)
    run = F.least(F.lit(max(k for k in range(shards) if ends[k] > (ends[k - 1] if k else 0)) if ends[-1] else shards - 1),
                  F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle)))
    cut = placed.join(begins, ["__curve", "__text"], "left").withColumn("__shard", F.when(F.col("__home") >= 0, F.col("__home")).otherwise(run).cast("int"))
    first = cut.groupBy("__shard", (F.col("__home") >= 0).alias("__housed")).agg(F.min("__index").alias("__least"), F.count("*").alias("__rows"))
    along = Window.partitionBy("__shard").orderBy("__housed").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("__shard", "__housed", "__least", F.coalesce(F.sum("__rows").over(along), F.lit(0)).alias("__base"))  # two rows a shard
    return cut.withColumn("__housed", F.col("__home") >= 0).join(F.broadcast(first), ["__shard", "__housed"]).select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), (F.col("__base") + F.col("__index") - F.col("__least")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("__curve").alias("curve"))
