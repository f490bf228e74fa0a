"""Exact duplicates by two-pass Bloom filtering.

Pass one sets, for every text hash, its positions in a Bloom filter and keeps the positions that were set at least twice.
Pass two probes that filter: a text whose positions are not all kept is certainly single and passes straight through,
only the possibly repeated rows shuffle. The filter is sized by the row count up to 16 MB; past that more single rows
are taken for suspects and shuffle, with the same result.

Defined cases: null text counts as empty; an empty table gives an empty result; rows with a null id take part and the
largest non-null id stays (a group without any id keeps one of its rows); rows repeated with the same id and text are one
group in the report and ``deduplicate`` returns one of them; extra columns pass through whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bits_for, bitmap_of, in_bitmap, stored

#: Positions that one hash sets in the filter.
PROBES = 2


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _positions(hashed: Column, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(hashed, F.lit(k)), F.lit(bits)) for k in range(PROBES)))


def repeated_filter(df: DataFrame, hashed: Column) -> Broadcast:
    """Pass one: the positions that two rows or more have set. The rows of a hot text combine before the shuffle."""
    held = df.select(hashed.alias("h"))
    bits = bits_for(held.count())
    twice = held.select(F.explode(_positions(F.col("h"), bits)).alias("p")).groupBy("p").agg(F.count("*").alias("n")).filter("n > 1")
    return bitmap_of(twice, F.col("p"), bits)


def possibly_repeated(hashed: Column, twice: Broadcast) -> Column:
    """Pass two: whether all positions of a hash were set twice."""
    bits = len(twice.value) * 8

    @F.pandas_udf("boolean")
    def probe(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(twice.value, first.to_numpy()) & in_bitmap(twice.value, second.to_numpy()))

    return probe(*(F.pmod(F.xxhash64(hashed, F.lit(k)), F.lit(bits)) for k in range(PROBES)))


def _groups(suspects: DataFrame) -> DataFrame:
    """One row a text; written, so that the join with it sees two plain tables and can split a hot text over many tasks."""
    return stored(suspects.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count("*").alias("__size")), "exact-groups")


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    base = df.select(F.col(id_col).alias("__id"), F.sha2(_text(text_col), 256).alias("__sha"), F.xxhash64(_text(text_col)).alias("__h"))
    twice = repeated_filter(df, F.xxhash64(_text(text_col)))
    flagged = possibly_repeated(F.col("__h"), twice)
    single = base.filter(~flagged).select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    suspects = base.filter(flagged).select("__id", "__sha")
    told = suspects.join(_groups(suspects), "__sha").select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256"))
    return single.unionByName(told)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns unchanged: of equal texts the row with the largest id."""
    twice = repeated_filter(df, F.xxhash64(_text(text_col)))
    flagged = possibly_repeated(F.xxhash64(_text(text_col)), twice)
    suspects = df.filter(flagged).withColumns({"__sha": F.sha2(_text(text_col), 256), "__id": F.col(id_col)})
    groups = _groups(df.filter(flagged).select(F.sha2(_text(text_col), 256).alias("__sha"), F.col(id_col).alias("__id")))
    stay = suspects.join(groups, "__sha").filter(F.col("__id").eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    return df.filter(~flagged).unionByName(stay.select(*(F.col(f"`{c}`") for c in df.columns)))
