"""Data-quality, label and leakage checks, feature screens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.series import Pieces, correlation, guarded, ratio
from .bars import TIMEFRAMES

c = F.col


def melt(df: DataFrame, **columns: Sequence[Column]) -> DataFrame:
    """One row per item from parallel lists of expressions over a one-row frame."""
    n = len(next(iter(columns.values())))
    items = F.array(*[F.struct(*[v[i].alias(k) for k, v in columns.items()]) for i in range(n)])
    return df.select(F.explode(items).alias("i")).select("i.*")


def dataset_statistics(bars: DataFrame) -> DataFrame:
    """Per timeframe and in total: symbols, rows, first and last time."""
    return bars.rollup("timeframe").agg(F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
                                        ).withColumn("timeframe", F.coalesce("timeframe", F.lit("TOTAL")))


def null_report(df: DataFrame) -> DataFrame:
    """Share of nulls (and NaN) in percent, two decimals, columns with any."""
    bad = lambda n, t: (c(n).isNull() | F.isnan(n)) if t in ("double", "float") else c(n).isNull()
    cols = df.dtypes
    one = df.agg(*[(F.avg(bad(n, t).cast("int")) * 100).alias(n) for n, t in cols])
    return melt(one, column=[F.lit(n) for n, _ in cols], null_pct=[F.round(c(n), 2) for n, _ in cols]).filter("null_pct > 0")


def outliers(df: DataFrame, columns: Sequence[str] = ("close", "high", "low", "volume"), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows outside three times the 1-99 % span, per key and column."""
    q = exact_quantiles(df, keys, columns, [0.01, 0.99]).select(*keys, "column", c("q")[0].alias("q01"), c("q")[1].alias("q99"))
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("double").alias("v")) for x in columns])).alias("i")).select(*keys, "i.*")
    span = c("q99") - c("q01")
    out = (c("v") < c("q01") - 3 * span) | (c("v") > c("q99") + 3 * span)
    return long.join(q, [*keys, "column"]).groupBy(*keys, "column").agg(F.first("q01").alias("q01"), F.first("q99").alias("q99"), F.count_if(out).alias("outliers"))


def temporal_integrity(bars: DataFrame, timeframe: str, rows: int | None = None) -> DataFrame:
    """Gaps longer than 1.5 intervals and backward steps in arrival order (``pos``)."""
    s = Pieces(bars, halo=1, rows=rows)
    s.stage(_d=F.unix_seconds("ts") - F.unix_seconds(s.lag("ts")))
    g = s.stage(d=c("_d")).close().groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c("d") < 0).alias("backward_steps"), F.count_if(c("d") > TIMEFRAMES[timeframe] * 1.5).alias("gaps"))
    return g.withColumns({"monotonic": c("backward_steps") == 0, "flagged": c("gaps") > c("rows") * 0.01, "gap_pct": c("gaps") / c("rows") * 100})


def class_distribution(df: DataFrame, label: str = "target", keys: Sequence[str] = (), limit: float = 5.0) -> DataFrame:
    """Counts, percent (one decimal) and the imbalance ratio of classes."""
    n = df.filter(c(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        tot = n.groupBy(*keys).agg(F.sum("n").alias("_t"), (F.max("n") / F.min("n")).alias("imbalance"))
        n = n.join(tot, list(keys))
    else:
        tot = n.agg(F.sum("n").alias("_t"), (F.max("n") / F.min("n")).alias("imbalance"), F.lit(1).alias("_one"))
        n = n.join(F.broadcast(tot), F.lit(1) == c("_one")).drop("_one")
    return n.withColumns({"pct": F.round(c("n") / c("_t") * 100, 1), "flagged": c("imbalance") > limit}).drop("_t")


def target_summary(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, keys, [label], [0.25, 0.5, 0.75]).select(*keys, c("q")[0].alias("q25"), c("q")[1].alias("median"), c("q")[2].alias("q75"))
    m = df.groupBy(*keys).agg(F.count(label).alias("n"), F.avg(label).alias("mean"), F.stddev_samp(label).alias("std"), F.min(label).alias("min"), F.max(label).alias("max"))
    if keys:
        return m.join(q, list(keys))
    return m.join(F.broadcast(q.withColumn("_one", F.lit(1))), F.lit(1) == c("_one")).drop("_one")


# ---------------------------------------------------------------- screens on feature matrices


#: Complete rows that a correlation matrix needs.
FEWEST_ROWS = 100


def _matrix(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, int]:
    """Correlation matrix (features x features) of complete rows; its size is fixed by the feature list."""
    if len(features) > 1000:
        raise ValueError("correlation matrices are meant for at most 1000 features")
    full = df.select(*[c(f).cast("double").alias(f) for f in features]).dropna()
    n = full.count()
    if n < FEWEST_ROWS:
        return np.full((len(features), len(features)), np.nan), n
    v = VectorAssembler(inputCols=list(features), outputCol="v").transform(full).select("v")
    return Correlation.corr(v, "v").first()[0].toArray(), n


def correlated_pairs(df: DataFrame, features: Sequence[str], high: float = 0.95, moderate: float = 0.80) -> DataFrame:
    """Feature pairs above the moderate bound with their band, strongest first."""
    m, n = _matrix(df, features)
    rows = [] if n < FEWEST_ROWS else [(features[i], features[j], float(abs(m[i, j])), "high" if abs(m[i, j]) > high else "moderate")
                               for i in range(len(features)) for j in range(i + 1, len(features)) if abs(m[i, j]) > moderate]
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, corr double, band string").orderBy(F.desc("corr"))


def inflation_factors(df: DataFrame, features: Sequence[str], limit: float = 10.0, approximate: bool = False) -> DataFrame:
    """Variance inflation per feature over all rows, from the correlation matrix."""
    m, n = _matrix(df, features)
    if n < FEWEST_ROWS:  # too few complete rows for a verdict
        return df.sparkSession.createDataFrame([(f, None, None) for f in features], "feature string, vif double, flagged boolean")
    if approximate:
        off = np.abs(m - np.eye(len(features)))
        vif = 1 / (1 - off.max(axis=1) ** 2 + 1e-10)
    else:
        vif = np.diag(np.linalg.pinv(m))
    rows = [(f, float(x), bool(x > limit)) for f, x in zip(features, vif)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, flagged boolean")


def low_variance(df: DataFrame, features: Sequence[str], limit: float = 0.01) -> DataFrame:
    one = df.dropna(subset=list(features)).agg(*[F.var_pop(f).alias(f) for f in features])
    return melt(one, feature=[F.lit(f) for f in features], variance=[c(f) for f in features]).withColumn("dropped", c("variance") <= limit)


def feature_stability(df: DataFrame, features: Sequence[str], slices: int = 5, pos: str = "pos", total: str = "n") -> DataFrame:
    """Variation of means and deviations over equal time slices; over 1 is unstable."""
    size = F.floor(c(total) / slices)
    d = df.withColumn("_slice", F.floor(c(pos) / size)).filter(c("_slice") < slices)
    item = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("v")) for f in features]))
    per = d.select("_slice", item.alias("i")).groupBy("_slice", "i.feature").agg(F.count("i.v").alias("k"), F.avg("i.v").alias("m"), F.stddev_samp("i.v").alias("s")).filter("k > 10")
    g = per.groupBy("feature").agg(F.count(F.lit(1)).alias("slices"), guarded(F.stddev_pop("m"), F.avg(F.abs("m"))).alias("mean_cv"), guarded(F.stddev_pop("s"), F.avg("s")).alias("std_cv"))
    return g.filter("slices >= 3").withColumn("unstable", (c("mean_cv") > 1) | (c("std_cv") > 1))


def target_correlations(df: DataFrame, features: Sequence[str], target: str, limits: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """|correlation| of every feature with the target and the bounds it passes."""
    one = df.agg(*[correlation(c(f).cast("double"), c(target).cast("double")).alias(f) for f in features])
    out = melt(one, feature=[F.lit(f) for f in features], corr=[c(f) for f in features])
    return out.withColumns({f"above_{int(x * 10)}": F.coalesce(F.abs("corr") > x, F.lit(False)) for x in limits})


def look_ahead_check(bars: DataFrame, limit: float = 0.3, rows: int | None = None) -> DataFrame:
    """Correlation of volume with the next bar's return, per symbol."""
    s = Pieces(bars, halo=1, ahead=1, rows=rows)
    s.stage(future_return=ratio(s.lead("close"), "close") - 1)
    g = s.close().groupBy("symbol").agg(correlation(c("volume").cast("double"), c("future_return")).alias("corr"))
    return g.withColumn("suspicious", F.abs("corr") > limit)


def suspicious_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column names that hint at target information; whole words, so ``buy_`` does not match ``y_``."""
    names = df.sparkSession.createDataFrame([(n,) for n in columns], "column string")
    return names.filter(c("column").rlike(r"(?i)(^|_)(target|future|label|y)(_|$)") & (c("column") != "target"))


def half_distributions(df: DataFrame, label: str = "target", pos: str = "pos", total: str = "n", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Class counts in the two halves of each series; identical counts are suspicious."""
    half = (c(pos) >= F.floor(c(total) / 2)).cast("int").alias("half")
    g = df.filter(c(label).isNotNull()).groupBy(*keys, label).agg(F.count_if(half == 0).alias("first_half"), F.count_if(half == 1).alias("second_half"))
    return g.groupBy(*keys).agg(F.sum(F.abs(c("first_half") - c("second_half"))).alias("difference"), F.max("first_half").alias("top_first"), F.max("second_half").alias("top_second")
                                ).withColumn("identical", c("difference") == 0)


def horizon_check(df: DataFrame, label: str, horizon: int, pos: str = "pos", total: str = "n", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last ``horizon`` targets must be null, ten times the horizon rows present, at most 20 % nulls."""
    tail = c(pos) >= c(total) - horizon
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(tail & c(label).isNull()).alias("null_tail"), (F.avg(c(label).isNull().cast("int")) * 100).alias("null_pct"))
    return g.withColumns({"shift_ok": c("null_tail") == horizon, "enough_rows": c("rows") >= horizon * 10, "nulls_ok": c("null_pct") <= 20})


def scaling_leak(df: DataFrame, feature: str, train: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """How far full-series scaling parameters are from train-only ones."""
    g = df.groupBy(*keys).agg(F.avg(feature).alias("mean_all"), F.stddev_pop(feature).alias("std_all"), F.avg(F.when(train, c(feature))).alias("mean_train"),
                              F.stddev_pop(F.when(train, c(feature))).alias("std_train"))
    return g.withColumns({"mean_shift": ratio(F.abs(c("mean_all") - c("mean_train")), "std_train"), "std_ratio": ratio("std_all", "std_train")})


#: Parts of a name that assign a feature to a model.
GROUPS: Mapping[str, Sequence[str]] = {
    "scalp": ("log_return", "rsi_", "micro_vol", "volume_ratio", "volume_spike", "atr_", "spread_", "cum_return"),
    "intraday": ("sma_", "ema_", "macd", "bb_", "adx", "obv", "vwap", "regime", "trend"),
    "swing": ("weekly", "monthly", "long_term", "correlation_btc", "beta", "funding", "open_interest", "sentiment"),
    "risk": ("volatility", "drawdown", "var_", "cvar", "sharpe", "sortino", "max_dd", "stress"),
}
#: Features that a model has at least, and how many it is given when it has fewer.
FEWEST, GIVEN = 5, 10


def assign_features(spark, names: Sequence[str], removed: DataFrame | None = None, minimum: int = FEWEST) -> DataFrame:
    """``(model, feature)`` by name, pruned by a table of removed names.

    A model with fewer than ``minimum`` features takes more: for scalp those among the first ten of all features that it
    lacks, for the others the first ten that they lack. The order is that of ``names``.
    """
    base = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, feature string")
    kept = base.join(removed.select("feature").distinct(), "feature", "left_anti") if removed is not None else base
    kept = kept.withColumn("all_k", F.row_number().over(Window.orderBy("k")))  # one row a column name
    rows = kept.select("feature", "all_k", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lower("feature").rlike("|".join(p)).alias("hit")) for m, p in GROUPS.items()])).alias("g")).select("feature", "all_k", "g.*")
    one = Window.partitionBy("model")
    rows = rows.withColumns({"own": F.count_if("hit").over(one), "lack_k": F.count_if(~c("hit")).over(one.orderBy("all_k"))})
    more = ~c("hit") & (c("own") < minimum) & F.when(c("model") == "scalp", c("all_k") <= GIVEN).otherwise(c("lack_k") <= GIVEN)
    return rows.filter(c("hit") | more).select("feature", "model")


def missing_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    have = df.sparkSession.createDataFrame([(n,) for n in df.columns], "column string")
    return df.sparkSession.createDataFrame([(n,) for n in expected], "column string").exceptAll(have)


