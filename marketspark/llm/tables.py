"""Spark-side helpers of the corpus operators: bounded bitmaps, ordered positions, tables in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.session import shared_folder

#: Bits of the largest bitmap that is broadcast: 16 MB, whatever the input. A full bitmap lets more rows through; results stay the same.
MOST_BITS = 1 << 27
#: Bytes of one Arrow batch, so that batches of long texts stay small in every task.
ARROW_BYTES = 4 << 20
#: Bits that one value of bitmap_construct_agg holds (a fixed value of Spark).
PAGE = 32768


def ship(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches and sends this package's source to the executors once, for clusters where it is
    not installed."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if getattr(sc, "_shipped_marketspark", False):
        return spark
    import marketspark

    root = Path(marketspark.__file__).resolve().parent
    into = Path(tempfile.mkdtemp(prefix="spark-")) / "marketspark.zip"  # the driver serves it from here
    with zipfile.ZipFile(into, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"marketspark/{f.relative_to(root)}")
    sc.addPyFile(str(into))
    sc._shipped_marketspark = True
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def bits_for(rows: int, each: int = 16) -> int:
    """Power of two of at least ``each`` bits a row, between one page and MOST_BITS."""
    return min(MOST_BITS, max(PAGE, 1 << max(0, int(rows * each - 1).bit_length())))


def collect_bitmap(pages: DataFrame, bits: int) -> np.ndarray:
    """Pages (bucket number from 1, 4 KB of bits) as one array of ``bits`` / 8 bytes: bounded by MOST_BITS."""
    out = np.zeros(bits // 8, np.uint8)
    for page, held in pages.toLocalIterator():
        lo = (page - 1) * (PAGE // 8)
        out[lo:lo + len(held)] = np.frombuffer(bytes(held), np.uint8)
    return out


def bitmap_of(df: DataFrame, hashed: Column, bits: int) -> Broadcast:
    """Broadcast bitmap of the values of ``hashed`` (longs) modulo ``bits``: at most 16 MB."""
    bit = F.pmod(hashed, F.lit(bits))
    pages = (df.select((bit + 1).alias("b")).filter("b IS NOT NULL")
             .groupBy(F.bitmap_bucket_number("b").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("held")))
    return df.sparkSession.sparkContext.broadcast(collect_bitmap(pages, bits))


def in_bitmap(held: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which longs have their bit set."""
    bit = np.asarray(hashed).astype(np.int64).view(np.uint64) & np.uint64(len(held) * 8 - 1)
    return (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Partitions and their order stay as they were computed."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Parquet table in the shared folder, for a result that several later passes read."""
    from marketspark.session import materialize

    return materialize(df, name, **options)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_positions(df: DataFrame, keys: list[str], sums: dict[str, str | None]) -> DataFrame:
    """Rows of a narrow table in the global order of ``keys``, with running sums over all rows before each.

    ``sums`` names each new column and the column it adds up (None counts rows). The table is range-sorted once (``keys``
    should end in something that tells equal rows apart, so that ties split) and checkpointed, so that partitions stay
    fixed; the driver then sees one row of totals a partition.
    """
    n = shuffle_width(df.sparkSession)
    kept = checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    names = list(sums)

    def sizes(b: pa.RecordBatch, name: str) -> np.ndarray:
        if sums[name] is None:
            return np.ones(b.num_rows, np.int64)
        return b.column(b.schema.get_field_index(sums[name])).to_numpy(zero_copy_only=False).astype(np.int64)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = dict.fromkeys(names, 0)
        for b in batches:
            for name in names:
                run[name] += int(sizes(b, name).sum())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "totals": [list(run.values())]})

    before, run = {}, [0] * len(names)
    for part, found in sorted(tuple(r) for r in kept.mapInArrow(totals, "part long, totals array<long>").collect()):
        before[part] = run
        run = [a + b for a, b in zip(run, found)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(zip(names, before.get(TaskContext.get().partitionId(), run)))
        for b in batches:
            for name in names:
                ends = at[name] + np.cumsum(size := sizes(b, name))
                b = b.append_column(name, pa.array(ends - size, pa.int64()))
                at[name] = int(ends[-1]) if len(ends) else at[name]
            yield b

    fields = [f"`{n}` {t}" for n, t in kept.dtypes] + [f"`{n}` long" for n in names]
    return kept.mapInArrow(place, ", ".join(fields))
