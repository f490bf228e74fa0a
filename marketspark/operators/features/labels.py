"""Targets that look ahead: direction, risk and future volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.series import Pieces, clip, flag, guarded, ratio
from .base import DOWN, FLAT, UP

#: Fixed values: (horizon bars, threshold) per model.
LABELS = {"scalp": (12, 0.003), "intraday": (6, 0.01), "swing": (7, 0.03)}


def classify(future: Column, threshold: float, fill_flat: bool = False) -> Column:
    """Three classes from a future return; an unknown return is null, or flat on request."""
    known = F.when(future > threshold, F.lit(UP)).when(future < -threshold, F.lit(DOWN))
    return known.otherwise(F.lit(FLAT)) if fill_flat else known.when(future.isNotNull(), F.lit(FLAT))


def direction(bars: DataFrame, horizon: int, threshold: float, fill_flat: bool = False,
              adaptive: bool = False, rows: int | None = None) -> DataFrame:
    """``future_return`` over ``horizon`` bars and its class.

    ``adaptive`` shortens the horizon to min(h, max(1, n//10)) and needs a length column ``n``.
    """
    s = Pieces(bars, halo=1, ahead=horizon, rows=rows)
    if not adaptive:
        target = s.lead("close", horizon)
    else:
        h = F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
        window = F.collect_list("close").over(s.frame(1, horizon))
        target = F.when(F.size(window) >= h, F.get(window, (h - 1).cast("int")))
    s.stage(future_return=ratio(target, "close") - 1)
    return s.stage(target=classify(F.col("future_return"), threshold, fill_flat)).close()


def next_bar(bars: DataFrame, threshold: float = 0.002, binary: bool = False, rows: int | None = None) -> DataFrame:
    """Label of the very next bar; rows without one are dropped."""
    s = Pieces(bars, halo=1, ahead=1, rows=rows)
    s.stage(future_return=ratio(s.lead("close"), "close") - 1)
    label = (F.col("future_return") > 0).cast("int") if binary else classify(F.col("future_return"), threshold)
    return s.stage(target=label).close().filter("future_return is not null")


def risk_score(bars: DataFrame, horizon: int = 12, stop: float = 0.02, rows: int | None = None) -> DataFrame:
    """Worst move against either side, stop hit, volatility spike and their blend."""
    s = Pieces(bars, halo=64, ahead=horizon, rows=rows)
    s.stage(_ret=s.pct("close"))
    s.stage(
        mae_long=ratio(F.col("close") - s.ahead(F.min, "low", horizon), "close"),
        mae_short=ratio(s.ahead(F.max, "high", horizon) - F.col("close"), "close"),
        _now=s.vol("_ret", 20),
        _next=s.ahead(F.stddev_samp, "_ret", horizon),
    )
    s.stage(
        max_adverse_excursion=F.greatest("mae_long", "mae_short"),
        sl_hit_long=flag(F.col("mae_long") > stop),
        sl_hit_short=flag(F.col("mae_short") > stop),
        volatility_spike=flag(guarded("_next", "_now") > 1.5),
    )
    s.stage(stop_loss_hit=F.greatest("sl_hit_long", "sl_hit_short"))
    score = (0.4 * clip("max_adverse_excursion", 0.0, 0.1) / 0.1
             + 0.3 * F.col("stop_loss_hit") + 0.3 * F.col("volatility_spike"))
    return s.stage(risk_score=clip(score, 0.0, 1.0)).close()


def future_volatility(bars: DataFrame, window: int = 20, log: bool = False, rows: int | None = None) -> DataFrame:
    """Deviation of the next ``window`` returns; the log form is scaled by sqrt(252)."""
    s = Pieces(bars, halo=1, ahead=window, rows=rows)
    s.stage(_prev=s.lag("close"))
    s.stage(_r=F.log(ratio("close", "_prev")) if log else ratio("close", "_prev") - 1)
    value = s.ahead(F.stddev_samp, "_r", window)
    return s.stage(future_volatility=value * F.sqrt(F.lit(252.0)) if log else value).close()


def tail_event(returns: DataFrame, column: str, p05: Column | float, hard: float = -0.02) -> DataFrame:
    """1 for a return under the hard bound or under the fifth percentile."""
    soft = p05 if isinstance(p05, Column) else F.lit(p05)
    return returns.withColumn("tail_event", ((F.col(column) < hard) | (F.col(column) < soft)).cast("int"))
