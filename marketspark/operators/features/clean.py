"""Filling, clipping and scaling of feature columns.

Per-symbol parameters are joined back on the symbol: the parameter table is one row per symbol,
which Spark broadcasts while it is small and joins with skew splitting otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.quantiles import exact_quantiles, wide_quantiles
from ...functions.series import PIECE_ROWS, ratio, running


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def zero_bad(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Matrix clean before training or scoring: NaN, infinities and nulls become 0."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in features})


def fill(df: DataFrame, features: Sequence[str], look_ahead: bool = False, keys: Sequence[str] = ("symbol",),
         pos: str = "pos") -> DataFrame:
    """Carry the last known value forward, then 0.

    ``look_ahead`` also fills the head of a series with its first known value, as the published
    pipelines do; it leaks the future and is off by default.
    """
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in features})
    out = running(df, keys, [pos], F.floor(F.col(pos) / PIECE_ROWS),
                  {f"_f_{c}": ("last", F.col(c)) for c in features})
    if look_ahead:
        firsts = df.groupBy(*keys).agg(*[
            F.min(F.when(F.col(c).isNotNull(), F.struct(pos, c)))[c].alias(f"_h_{c}") for c in features
        ])
        out = out.join(firsts, list(keys), "left")
    head = (lambda c: [F.col(f"_h_{c}")]) if look_ahead else (lambda c: [])
    out = out.withColumns({c: F.coalesce(F.col(f"_f_{c}"), *head(c), F.lit(0.0)) for c in features})
    return out.drop(*[f"_{p}_{c}" for p in "fh" for c in features])


def clip_bounds(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",),
                lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Exact outer quantiles per key and feature: ``(keys, column, lo, hi)``."""
    q = exact_quantiles(df, keys, features, [lo, hi])
    return q.select(*keys, "column", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def _attach(df: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return df.join(params, list(keys), "left")
    return df.join(F.broadcast(params.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), "left").drop("_one")


def clip_outer(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",),
               lo: float = 0.001, hi: float = 0.999, fit: Column | None = None) -> DataFrame:
    out = _attach(df, wide_quantiles(df.filter(fit) if fit is not None else df, keys, features, [lo, hi]), keys)
    return out.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col(f"_q{i}")[0]), F.col(f"_q{i}")[1]))
        for i, c in enumerate(features)
    }).drop(*[f"_{x}{i}" for x in "nq" for i in range(len(features))])


def standard_scale(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",),
                   fit: Column | None = None, floor: float = 1e-8) -> DataFrame:
    """(x-mean)/std with population std of the rows selected by ``fit``; a tiny std counts as 1."""
    rows = df.filter(fit) if fit is not None else df
    stats = rows.groupBy(*keys).agg(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_z_{c}") for c in features
    ])
    out = _attach(df, stats, keys)
    scale = lambda c: F.when(F.col(f"_z_{c}.s") < floor, F.lit(1.0)).otherwise(F.col(f"_z_{c}.s"))
    return out.withColumns({c: (F.col(c) - F.col(f"_z_{c}.m")) / scale(c) for c in features}).drop(*[f"_z_{c}" for c in features])


def robust_params(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), fit: Column | None = None) -> DataFrame:
    """Median and interquartile range per feature: ``(keys, column, median, iqr)``."""
    rows = df.filter(fit) if fit is not None else df
    q = exact_quantiles(rows, keys, features, [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select(*keys, "column", F.col("q")[1].alias("median"), F.when(iqr < 1e-10, F.lit(1.0)).otherwise(iqr).alias("iqr"))


def robust_scale(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), fit: Column | None = None) -> DataFrame:
    """(x - median) / interquartile range of the rows selected by ``fit``; a tiny range counts as 1."""
    out = _attach(df, wide_quantiles(df.filter(fit) if fit is not None else df, keys, features, [0.25, 0.5, 0.75]), keys)

    def scaled(i: int, c: str) -> Column:
        iqr = F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]
        return ratio(F.col(c) - F.col(f"_q{i}")[1], F.when(iqr < 1e-10, F.lit(1.0)).otherwise(iqr))

    return out.withColumns({c: scaled(i, c) for i, c in enumerate(features)}).drop(*[f"_{x}{i}" for x in "nq" for i in range(len(features))])


def live_vector(features_df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",), pos: str = "pos") -> DataFrame:
    """Latest complete row per symbol, standardized over the complete rows of the window."""
    full = features_df.dropna(subset=list(features))
    stats = full.groupBy(*keys).agg(
        F.max_by(F.struct(pos, *features), pos).alias("_last"),
        *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_z_{c}") for c in features],
    )
    value = lambda c: F.coalesce(ratio(F.col(f"_last.{c}") - F.col(f"_z_{c}.m"),
                                       F.when(F.col(f"_z_{c}.s") == 0, F.lit(1.0)).otherwise(F.col(f"_z_{c}.s"))), F.lit(0.0))
    return stats.select(*keys, F.col(f"_last.{pos}").alias(pos), *[value(c).alias(c) for c in features])
