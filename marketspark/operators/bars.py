"""Ticks to calendar-complete bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import PIECE_ROWS
from ..session import materialize

DAY = 86_400

#: Bar width in seconds per timeframe name.
TIMEFRAMES = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1_800, "1h": 3_600, "4h": 14_400, "12h": 43_200,
    "1d": DAY, "3d": 3 * DAY, "1w": 7 * DAY,
}
#: Width used for an unknown timeframe name.
DEFAULT_WIDTH = 300
#: The epoch is a Thursday; a Monday-based week starts four days later, and its label is its Sunday.
WEEK_SHIFT, WEEK_LABEL = 4 * DAY, 6 * DAY


def width_of(timeframe: str) -> int:
    return TIMEFRAMES.get(timeframe, DEFAULT_WIDTH)


def bin_start(ts: Column, timeframe: str, anchor: Column | None = None) -> Column:
    """Bin start in epoch seconds: from midnight, from the anchor day (3d), from Monday (1w)."""
    w = width_of(timeframe)
    sec = F.unix_seconds(ts)
    if timeframe == "1w":
        shift = F.lit(WEEK_SHIFT)
    elif timeframe == "3d" and anchor is not None:
        shift = anchor % w
    else:
        shift = F.lit(0)
    return (F.floor((sec - shift) / w) * w + shift).cast("long")


def bin_label(start: Column, timeframe: str) -> Column:
    return F.timestamp_seconds(start + (WEEK_LABEL if timeframe == "1w" else 0))


def _binned(ticks: DataFrame, timeframe: str, rows: int) -> DataFrame:
    anchor = None
    if timeframe == "3d":
        first = ticks.groupBy("symbol").agg((F.floor(F.unix_seconds(F.min("ts")) / DAY) * DAY).alias("_anchor"))
        ticks = ticks.join(first, "symbol")
        anchor = F.col("_anchor")
    span = width_of(timeframe) * rows
    return ticks.withColumn("_bin", bin_start(F.col("ts"), timeframe, anchor)).withColumn(
        "_part", F.floor(F.col("_bin") / span)
    ).drop("_anchor")


#: Aggregates of one bar; all of them combine before the shuffle.
def bar_columns() -> list[Column]:
    when = F.struct("ts", "id")
    sold = F.col("is_buyer_maker")
    return [
        F.min_by("price", when).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", when).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(F.when(~sold, F.col("qty")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(sold, F.col("qty")).otherwise(0.0)).alias("sell_volume"),
        F.count("price").alias("trades_count"),
    ]


def sparse_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Bars of the bins that have ticks."""
    b = _binned(ticks, timeframe, PIECE_ROWS)
    return b.groupBy("symbol", "_bin").agg(*bar_columns()).select(
        "symbol", bin_label(F.col("_bin"), timeframe).alias("ts"), "open", "high", "low", "close", "volume",
        "buy_volume", "sell_volume", "trades_count")


def _recent(binned: DataFrame, starts: DataFrame) -> DataFrame:
    """Ticks of the bins after each symbol's ``_start`` and of the one that reaches it.

    The few bins that say so are written, so that Spark knows their size and broadcasts them while it allows.
    """
    reaches = F.max(F.when(F.col("_bin") <= F.col("_start"), F.col("_bin")))
    since = binned.join(starts, "symbol").groupBy("symbol").agg(F.coalesce(reaches, F.min("_bin")).alias("_since"))
    return binned.join(materialize(since, "since"), "symbol").filter(F.col("_bin") >= F.col("_since")).drop("_since")


def resample(ticks: DataFrame, timeframe: str, rows: int = PIECE_ROWS, last: int | None = None) -> DataFrame:
    """Dense bars ``(symbol, ts, pos, n, open..trades_count)``: every bin from first to last.

    Empty bins repeat the previous bar's prices with zero volume.  Each bar emits its own
    following empty bins, so no series is ever gathered: the only per-symbol window runs
    over one row per ``rows`` bins.  ``last`` emits only the last so many bins of each symbol, with
    the same values; then only their ticks are shuffled.
    """
    w = width_of(timeframe)
    b = _binned(ticks, timeframe, rows)
    edges = b.groupBy("symbol", "_part").agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
    by_symbol = Window.partitionBy("symbol")
    edges = edges.select(
        "symbol", "_part", F.lead("_lo").over(by_symbol.orderBy("_part")).alias("_after"),
        F.min("_lo").over(by_symbol).alias("_first"), F.max("_hi").over(by_symbol).alias("_end"),
    )
    if last is not None:
        edges = materialize(edges, "edges")
        b = _recent(b, edges.select("symbol", (F.col("_end") - (last - 1) * w).alias("_start")).distinct())
    bars = b.groupBy("symbol", "_part", "_bin").agg(*bar_columns())
    inside = Window.partitionBy("symbol", "_part").orderBy("_bin")
    bars = bars.join(edges, ["symbol", "_part"]).withColumn(
        "_next", F.coalesce(F.lead("_bin").over(inside), "_after", F.col("_bin") + w)
    )
    start = F.col("_bin")
    if last is not None:
        start = F.greatest(start, F.col("_end") - (last - 1) * w)
        bars = bars.filter(F.col("_next") > start)
    bars = bars.withColumn("_at", F.explode(F.sequence(start, F.col("_next") - w, F.lit(w).cast("long"))))
    real = F.col("_at") == F.col("_bin")
    return bars.select(
        "symbol",
        bin_label(F.col("_at"), timeframe).alias("ts"),
        ((F.col("_at") - F.col("_first")) / w).cast("long").alias("pos"),
        ((F.col("_end") - F.col("_first")) / w + 1).cast("long").alias("n"),
        "open", "high", "low", "close",
        *[F.when(real, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("volume", "buy_volume", "sell_volume")],
        F.when(real, F.col("trades_count")).otherwise(F.lit(0)).alias("trades_count"),
    )
