"""Bars to trade signals, as one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Pieces
from ..operators import decide
from ..operators.asof import last_returns
from ..session import materialize

c = F.col


def tail(bars: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` bars of each symbol, where the bars tell how many there are."""
    return bars.filter(c("pos") >= c("n") - rows) if "n" in bars.columns else bars


def latest_market(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Latest row per symbol with close, 20-bar and 100-bar volatility of returns."""
    s = Pieces(tail(bars, 101), halo=128, rows=rows)
    s.stage(_ret=s.pct("close"))
    s.stage(volatility=s.vol("_ret", 20), avg_volatility=s.vol("_ret", 100))
    out = s.close().groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volatility", "avg_volatility"), "pos").alias("r"))
    return out.select("symbol", "r.ts", c("r.close").alias("price"), "r.volatility", "r.avg_volatility")


def momentum_outputs(bars: DataFrame, rows: int | None = None) -> dict[str, DataFrame]:
    """Stand-in model outputs from momentum: a logistic of the standardized return of three horizons.

    Trained models from ``operators.ml`` take the same place.
    """
    s = Pieces(tail(bars, 51), halo=256, rows=rows)
    s.stage(_ret=s.pct("close"))
    s.stage(_sd=s.vol("_ret", 50), **{f"_m{k}": s.pct("close", k) for k in (3, 10, 50)})
    s.stage(**{f"z{k}": F.try_divide(c(f"_m{k}"), c("_sd")) for k in (3, 10, 50)})
    last = materialize(s.close().groupBy("symbol").agg(F.max_by(F.struct("z3", "z10", "z50"), "pos").alias("r")), "momentum")
    out = {}
    for name, k in (("scalp", 3), ("intraday", 10), ("swing", 50)):
        up = 0.9 / (1 + F.exp(-c(f"r.z{k}") / k**0.5))
        d = last.select("symbol", up.alias("P_up"), F.lit(0.1).alias("P_flat"), (0.9 - up).alias("P_down"))
        out[name] = d.withColumn("expected_return", c("P_up") - c("P_down")).select("symbol", "P_up", "P_flat", "P_down", "expected_return").filter("P_up is not null")
    return out


def decisions(bars: DataFrame, outputs: dict[str, DataFrame], risk: DataFrame | None = None) -> DataFrame:
    symbols = bars.select("symbol").distinct()
    return decide.meta_decision(decide.assemble_predictions(symbols, outputs, risk))


def trade_signals(bars: DataFrame, outputs: dict[str, DataFrame], risk: DataFrame | None = None, correlate: bool = True) -> DataFrame:
    """Vote, rank, drop correlated symbols, size: at most five signals."""
    ranked = decide.rank_candidates(decisions(bars, outputs, risk))
    chosen = decide.select_uncorrelated(ranked, last_returns(bars) if correlate else None)
    return decide.signals(chosen, latest_market(bars).drop("ts"))
