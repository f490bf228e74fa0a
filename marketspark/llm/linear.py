"""Shared steps of the two text classifiers: which rows may teach, a bounded sample, one fit, one broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one class that a fit may see at most.
SAMPLE_ROWS = 4000


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def sampled(rows: DataFrame, label: str, salt: Column, most: int) -> DataFrame:
    """About ``most`` rows of each class at most, picked by a hash of ``salt``; all rows of smaller classes."""
    counts = dict(rows.groupBy(label).count().collect())  # one row a class
    if not counts:
        return rows.limit(0)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))))
    return rows.filter(F.pmod(F.xxhash64(salt, F.lit(17)), F.lit(1 << 20)) < F.element_at(share, F.col(label)) * F.lit(1 << 20))
