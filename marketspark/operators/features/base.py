"""Columns shared by the feature builders; computed once per builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.series import EPS, Pieces, col, flag, guarded, ratio

#: Class codes of the three-way direction label.
DOWN, FLAT, UP = 0, 1, 2

RAW = ("open", "high", "low", "close", "volume")


def begin(bars: DataFrame, halo: int = 1024, ahead: int = 0, rows: int | None = None, block: int = 512) -> Pieces:
    """Cut bars into pieces and add the usual per-bar changes."""
    s = Pieces(bars, halo=halo, ahead=ahead, rows=rows, block=block)
    s.stage(_prev=s.lag("close"))
    d = F.col("close") - F.col("_prev")
    return s.stage(
        _ret=ratio("close", "_prev") - 1,
        _lr=F.log(ratio("close", "_prev")),
        _gain=F.when(d > 0, d).otherwise(F.lit(0.0)),
        _loss=F.when(d < 0, -d).otherwise(F.lit(0.0)),
        _delta=d,
        _tr=true_range(F.col("_prev")),
        _tp=(F.col("high") + F.col("low") + F.col("close")) / 3,
    )


def true_range(prev: Column) -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def strength(gain: Column, loss: Column) -> Column:
    """Relative-strength oscillator 0..100 from mean gain and mean loss."""
    return 100 - ratio(F.lit(100.0), 1 + guarded(gain, loss))


def rsi(s: Pieces, period: int, live: bool = False) -> Column:
    """Simple-mean RSI.  The live form needs ``period`` real changes, so it starts a bar later."""
    value = strength(s.mean("_gain", period), s.mean("_loss", period))
    return F.when(F.col(s.pos) >= period, value) if live else value


def div(a, b, live: bool) -> Column:
    """Plain ratio in batch builders, guarded ratio in live ones."""
    return guarded(a, b) if live else ratio(a, b)


def zeros(s: Pieces, *names: str, value: float = 0.0) -> Pieces:
    return s.stage(**{n: F.lit(value) for n in names})


def opt(name: str) -> Column:
    return F.col(name)


__all__ = ["EPS", "Pieces", "begin", "col", "div", "flag", "guarded", "opt", "ratio", "rsi", "strength", "zeros",
           "DOWN", "FLAT", "UP", "RAW"]
