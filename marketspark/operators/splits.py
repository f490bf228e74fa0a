"""Time-ordered folds and hold-outs, as columns.

All of them work on a row position and a row count per series, so no split is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _fold_rows(df: DataFrame, folds: list[tuple[int, Column, Column, Column]], pos: str) -> DataFrame:
    """Rows per fold with role: ``folds`` are (id, train end, validation start, validation end)."""
    p = c(pos)
    role = lambda te, vs, ve: F.when(p < te, "train").when((p >= vs) & (p < ve), "valid")
    item = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), role(te, vs, ve).alias("role")) for i, te, vs, ve in folds]))
    return df.withColumn("_f", item).select("*", "_f.fold", "_f.role").drop("_f").filter("role is not null")


def expanding(df: DataFrame, folds: int = 5, pos: str = "pos", total: str = "n") -> DataFrame:
    """Expanding folds: test size n//(folds+1), training rows all before."""
    n = c(total)
    size = F.floor(n / (folds + 1))
    start = lambda i: n - (folds - i) * size
    return _fold_rows(df, [(i, start(i), start(i), start(i) + size) for i in range(folds)], pos)


def purged(df: DataFrame, folds: int = 5, horizon: int = 6, embargo: int = 1, test_size: float = 0.2, min_train: float = 0.3,
           pos: str = "pos", total: str = "n") -> DataFrame:
    """Purge = horizon + 2 and embargo between train and validation; folds step by a fifth of a fold.

    Consecutive validation windows overlap, as specified.
    """
    n = c(total)
    fold = F.floor(n * test_size)
    out = []
    for i in range(folds):
        end = F.floor(n * min_train) + i * F.floor(fold / folds)
        start = end + horizon + 2 + embargo
        stop = F.least(start + fold, n)
        # folds with fewer than ten validation rows are skipped
        stop = F.when(stop - start >= 10, stop).otherwise(start)
        out.append((i, F.when(stop > start, end).otherwise(F.lit(0)), start, stop))
    return _fold_rows(df, out, pos)


def purged_simple(df: DataFrame, folds: int = 5, purge: int = 6, embargo: int = 0, pos: str = "pos", total: str = "n") -> DataFrame:
    n = c(total)
    size = F.floor(n / (folds + 1))
    out = []
    for i in range(folds):
        start = size * (i + 1) + purge + embargo
        out.append((i, F.when(start < n, size * (i + 1)).otherwise(F.lit(0)), start, F.least(start + size, n)))
    return _fold_rows(df, out, pos)


def purged_by_trim(df: DataFrame, folds: int = 5, purge: int = 6, pos: str = "pos", total: str = "n") -> DataFrame:
    """Expanding folds whose training part loses the rows within the purge distance; small trains are dropped."""
    n = c(total)
    size = F.floor(n / (folds + 1))
    out = []
    for i in range(folds):
        start = n - (folds - i) * size
        end = start - purge
        keep = end > 100
        out.append((i, F.when(keep, end).otherwise(F.lit(0)), start, F.when(keep, start + size).otherwise(start)))
    return _fold_rows(df, out, pos)


def hold_out(df: DataFrame, shares: tuple[float, ...] = (0.8, 0.2), names: tuple[str, ...] = ("train", "test"), pos: str = "pos", total: str = "n") -> DataFrame:
    """Consecutive parts by position, e.g. 80/20, 85/15, 90/10 or 60/20/20."""
    out, acc = None, 0.0
    for share, name in zip(shares[:-1], names[:-1]):
        acc += share
        cond = c(pos) < F.floor(c(total) * round(acc, 10))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("part", out.otherwise(names[-1]))


def minimum_history(df: DataFrame, rows: int, total: str = "n") -> DataFrame:
    """Series with more than ``rows`` rows; the count per series is already a column."""
    return df.filter(c(total) > rows)


def sample_rows(df: DataFrame, share: float, key: list[str], seed: int = 42) -> DataFrame:
    """That share of the rows, chosen by a hash of the key, so a rerun keeps the same rows at any size."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) < int(1_000_000 * share))
