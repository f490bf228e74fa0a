"""Backward as-of joins and other time-aligned joins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import BUCKET, depth_bucket
from ..functions.series import Pieces, index_rows, ratio, running, time_bucket
from ..session import materialize, ship


@dataclass(frozen=True)
class Facts:
    """An irregular series to bring onto bars: its value columns and their defaults."""

    df: DataFrame
    columns: Sequence[str]
    defaults: Mapping[str, float] = field(default_factory=dict)


#: Columns and defaults of the six derivative families.
FAMILIES = {
    "funding": {"funding_rate": 0.0},
    "open_interest": {"sum_open_interest": 0.0, "sum_open_interest_value": 0.0},
    "long_short": {"long_short_ratio": 1.0, "long_account": 1.0, "short_account": 1.0},
    "taker": {"buy_sell_ratio": 1.0, "buy_vol": 1.0, "sell_vol": 1.0},
    "mark": {"mark_close": None},
    "premium": {"premium_close": 0.0},
}


def asof(bars: DataFrame, series: Sequence[Facts], keys: Sequence[str] = ("symbol",), ts: str = "ts",
         fill: bool = True, bucket_rows: int = BUCKET, tie: str | None = None) -> DataFrame:
    """Latest fact at or before each bar, for any number of fact series in one pass.

    Bars and facts are unioned and scanned in time buckets of equal depth (two-level), so a symbol
    with very many ticks, however short the time, spreads over its buckets.  The whole latest fact row is taken, a null value in it included; with
    ``fill`` a null is then carried forward over bars, and finally replaced by the default.
    ``tie`` orders facts of equal time.
    """
    base = bars.columns
    parts = [bars.withColumns({"_side": F.lit(len(series)), "_tie": F.lit(None).cast("string")})]
    specs, columns = {}, {}
    for i, f in enumerate(series):
        name = f"_fact{i}"
        value = F.struct(*f.columns).alias(name)
        order = (F.col(tie).cast("string") if tie else F.lit(None).cast("string")).alias("_tie")
        parts.append(f.df.select(*keys, ts, value, F.lit(i).alias("_side"), order))
        specs[name] = ("last", F.col(name))
        columns.update({c: F.col(name)[c] for c in f.columns})
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = depth_bucket(rows, keys, ts, "_depth", bucket_rows)
    out = running(rows.withColumnsRenamed({n: f"{n}_in" for n in specs}), keys, [ts, "_side", "_tie"],
                  F.col("_depth"), {n: (k, F.col(f"{n}_in")) for n, (k, _) in specs.items()})
    out = out.filter(F.col("_side") == len(series)).select(*base, "_depth", *[v.alias(c) for c, v in columns.items()])
    if fill:
        out = running(out.withColumnsRenamed({c: f"_v_{c}" for c in columns}), keys, [ts], F.col("_depth"),
                      {c: ("last", F.col(f"_v_{c}")) for c in columns}).drop(*[f"_v_{c}" for c in columns])
    out = out.drop("_depth")
    defaults = {c: d for f in series for c, d in f.defaults.items() if d is not None}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()}) if defaults else out


def with_derivatives(bars: DataFrame, families: Mapping[str, DataFrame], mode: str = "typed") -> DataFrame:
    """Join the derivative families onto bars.

    ``typed``: per-family defaults and ``basis``; ``zero``: funding, open interest, ratios and taker with
    default 0; ``raw``: no filling at all.
    """
    series = []
    for name, df in families.items():
        cols = FAMILIES[name]
        if mode == "zero" and name not in ("funding", "open_interest", "long_short", "taker"):
            continue
        have = [c for c in cols if c in df.columns]
        defaults = {"typed": cols, "zero": dict.fromkeys(cols, 0.0), "raw": {}}[mode]
        series.append(Facts(df, have, {c: defaults[c] for c in have if c in defaults}))
    out = asof(bars, series, fill=mode != "raw")
    if mode == "typed" and "mark" in families:
        out = out.withColumn("basis", ratio(F.col("close") - F.col("mark_close"), "mark_close") * 100)
    return out


def exact_join_fill(bars: DataFrame, facts: DataFrame, columns: Sequence[str], default: float | None = None,
                    keys: Sequence[str] = ("symbol",), bucket_rows: int = BUCKET) -> DataFrame:
    """Left join on equal time, then carry the last value forward."""
    renamed = facts.select(*keys, "ts", *[F.col(c).alias(f"_v_{c}") for c in columns])
    joined = depth_bucket(bars.join(renamed, [*keys, "ts"], "left"), keys, "ts", "_depth", bucket_rows)
    out = running(joined, keys, ["ts"], F.col("_depth"), {c: ("last", F.col(f"_v_{c}")) for c in columns}).drop("_depth", *[f"_v_{c}" for c in columns])
    if default is None:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def benchmark_returns(bars: DataFrame, symbol: str) -> DataFrame:
    """Return series ``(ts, btc_return)`` of one symbol."""
    s = Pieces(bars.filter(F.col("symbol") == symbol), halo=1)
    return s.stage(btc_return=s.pct("close")).close().select("ts", "btc_return")


def join_benchmark(bars: DataFrame, benchmark: DataFrame, live: bool = False) -> DataFrame:
    """Benchmark return of the same time on every symbol; null becomes 0.

    The benchmark has one row per bar time.  It is joined on time, which spreads evenly; Spark
    broadcasts it while its size allows.  The live form takes the latest return instead.
    """
    if live:
        times = bars.select("ts").distinct()
        benchmark = asof(times, [Facts(benchmark, ["btc_return"])], keys=(), fill=False)
    out = bars.join(benchmark, "ts", "left")
    return out if live else out.withColumn("btc_return", F.coalesce("btc_return", F.lit(0.0)))


def join_market_series(bars: DataFrame, series: DataFrame, column: str = "btc_dominance", default: float = 50.0) -> DataFrame:
    """Market-wide series on equal time, carried forward; a constant when there is none."""
    renamed = series.select("ts", F.col(column).alias("_v"))
    joined = bars.join(renamed, "ts", "left")
    return running(joined, ["symbol"], ["ts"], time_bucket("ts", 30 * 86_400), {column: ("last", F.col("_v"))}).drop("_v")


def rolling_pair_corr(bars: DataFrame, symbol: str, window: int = 24) -> DataFrame:
    """Rolling correlation of each symbol's returns with one symbol's, on their common times."""
    other = bars.filter(F.col("symbol") == symbol).select("ts", F.col("close").alias("base_close"))
    both = bars.join(other, "ts").drop("pos")
    both = index_rows(both, ["symbol"], ["ts"], time_bucket("ts", 30 * 86_400))
    s = Pieces(both, halo=window + 1)
    s.stage(_a=s.pct("close"), _b=s.pct("base_close"))
    return s.stage(corr=s.corr("_a", "_b", window)).close()


def last_returns(bars: DataFrame, window: int = 24) -> DataFrame:
    """``(symbol, r array of the last `window` returns)`` in time order; shorter series are left out.

    The window is bounded, so it fits one row per symbol.  Bars that carry ``pos`` and ``n`` are cut by these, so the long
    series is never sorted.
    """
    tail = bars
    if {"pos", "n"} <= set(bars.columns):
        tail = bars.filter(F.col("pos") >= F.col("n") - (window + 1))
    else:
        w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
        tail = bars.select("symbol", "ts", "close").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= window + 1)
    arr = F.array_sort(F.collect_list(F.struct("ts", "close")))
    rows = tail.groupBy("symbol").agg(arr.alias("a")).filter(F.size("a") == window + 1)
    return rows.select("symbol", F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: ratio(
        F.get("a", i)["close"], F.get("a", i - 1)["close"]) - 1).alias("r"))


def unit_returns(returns: DataFrame) -> DataFrame:
    """Return arrays centred and scaled to length one, so that a correlation is a dot product."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = returns.withColumn("_m", ratio(total(F.col("r")), F.size("r")))
    d = d.withColumn("_c", F.transform("r", lambda x: x - F.col("_m")))
    d = d.withColumn("_l", F.sqrt(total(F.transform("_c", lambda x: x * x))))
    return d.select("symbol", F.transform("_c", lambda x: ratio(x, F.col("_l"))).alias("u"))


#: Symbols of a block, about, rows of one product that are held at once, and parts of blocks at most, of which every two are a task.
PAIR_BLOCK, PAIR_STRIP, PAIR_PARTS = 4_096, 64, 64
PAIRS = "symbol_1 string, symbol_2 string, corr double"


def block_products(above: float | None):
    """Function over rows of two blocks, of which the first has the smaller symbols or is the second, that yields their pairs."""

    def unpacked(rows):
        symbols = rows.values.field("symbol")
        u = rows.values.field("u").flatten().to_numpy(zero_copy_only=False).reshape(len(symbols), -1)
        return symbols, np.where(np.isnan(u).any(axis=1, keepdims=True), 0.0, u)  # a constant series correlates with nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(batch.column("_p"), batch.column("_q")):
                (first, left), (second, right) = unpacked(p), unpacked(q)
                same = first[0] == second[0]
                at = np.arange(len(second))[:, None]
                for lo in range(0, len(first), PAIR_STRIP):
                    m = right @ left[lo:lo + PAIR_STRIP].T + 0.0  # by second symbol, then first: long runs of few values, which files hold in little room
                    keep = at > np.arange(lo, lo + m.shape[1]) if same else np.ones(m.shape, bool)
                    if above is not None:
                        keep &= np.abs(m) > above
                    j, i = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([first.take(pa.array(lo + i)), second.take(pa.array(j)), pa.array(m[j, i])], ["symbol_1", "symbol_2", "corr"])

    return run


def pair_correlations(returns: DataFrame, above: float | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """Correlation of every pair of symbols, or of those whose absolute value is over ``above``, as a blocked product.

    Symbols fall into ranges, whose number follows that of the symbols; a range is written as one row of about ``block`` symbols.
    Every two of these rows meet in a cross join, so nothing is copied before it, and their product is taken strip by strip.
    Without ``above`` the result has one row per pair.
    """
    spark = returns.sparkSession
    ship(spark)
    u = materialize(unit_returns(returns.filter(F.col("symbol").isNotNull())).withColumn("symbol", F.col("symbol").cast("string")), "unit-returns")
    n = u.count()
    blocks = max(1, -(-n // block), min(16, -(-n // 256)))
    u = u.repartitionByRange(blocks, "symbol").select(F.spark_partition_id().alias("_b"), F.struct("symbol", "u").alias("_row"))
    rows = materialize(u.groupBy("_b").agg(F.sort_array(F.collect_list("_row")).alias("_p")), "return-blocks")
    # one block a partition while these are few: a product is heavy on CPU for its bytes
    rows = rows.select("_p", F.get("_p", F.lit(0))["symbol"].alias("_s")).repartitionByRange(blocks, "_s").coalesce(min(blocks, PAIR_PARTS))
    pairs = rows.join(rows.toDF("_q", "_t").hint("shuffle_replicate_nl"), F.col("_s") <= F.col("_t"))
    return pairs.select("_p", "_q").mapInArrow(block_products(above), PAIRS)
