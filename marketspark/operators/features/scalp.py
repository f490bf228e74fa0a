"""Short-horizon features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import begin, div, flag, guarded, ratio, rsi
from ...functions.series import Pieces, clip


def log_returns(s: Pieces) -> Pieces:
    s.stage(**{f"log_return_{k}": F.log(ratio("close", s.lag("close", k))) for k in (1, 3, 5, 10)})
    return s.stage(cum_return_5=s.sum("log_return_1", 5), cum_return_10=s.sum("log_return_1", 10))


def rsi_set(s: Pieces, live: bool = False) -> Pieces:
    s.stage(**{f"rsi_{p}": (rsi(s, p, live) - 50) / 50 for p in (5, 7, 14)})
    return s.stage(rsi_slope=s.diff("rsi_14", 3))


def micro_volatility(s: Pieces) -> Pieces:
    s.stage(**{f"micro_vol_{k}": s.vol("_lr", k) for k in (3, 5, 10)},
            **{f"atr_{k}": s.mean("_tr", k) for k in (5, 10)})
    return s.stage(
        vol_ratio_3_10=guarded("micro_vol_3", "micro_vol_10"),
        atr_norm_5=ratio("atr_5", "close"),
        atr_norm_10=ratio("atr_10", "close"),
        atr_expansion=guarded("atr_5", "atr_10"),
    )


def volume_spikes(s: Pieces) -> Pieces:
    s.stage(**{f"_v{k}": s.mean("volume", k) for k in (5, 10, 20)}, volume_momentum=s.pct("volume", 3))
    s.stage(**{f"volume_ratio_{k}": guarded("volume", f"_v{k}") for k in (5, 10, 20)},
            volume_trend=guarded("_v5", "_v20") - 1)
    return s.stage(volume_spike=flag(F.col("volume_ratio_10") > 2))


def order_flow(s: Pieces) -> Pieces:
    """Taker-side imbalance from whichever input the table carries."""
    if s.has("taker_buy_base", "volume"):
        s.stage(buy_ratio=guarded("taker_buy_base", "volume"))
        pressure = F.col("buy_ratio") - 0.5
    elif s.has("buy_ratio"):
        pressure = F.col("buy_ratio") - 0.5
    elif s.has("buy_sell_ratio"):
        pressure = clip((F.col("buy_sell_ratio") - 1) / 2, -1, 1)
    else:
        return s
    s.stage(buy_pressure=pressure)
    return s.stage(
        buy_pressure_sma=s.mean("buy_pressure", 5),
        imbalance_momentum=s.diff("buy_pressure", 3),
        cum_imbalance_5=s.sum("buy_pressure", 5),
        cum_imbalance_10=s.sum("buy_pressure", 10),
    )


def derivatives(s: Pieces) -> Pieces:
    """Funding, open interest, long/short, taker, premium and basis features, as present."""
    if s.has("funding_rate"):
        s.stage(
            funding_rate_norm=F.col("funding_rate") * 1000,
            funding_rate_sma=s.mean("funding_rate", 8) * 1000,
            funding_rate_change=s.diff("funding_rate") * 1000,
            funding_rate_zscore=s.zscore("funding_rate", 24),
        )
    if s.has("sum_open_interest"):
        s.stage(oi_change=s.pct("sum_open_interest"), oi_zscore=s.zscore("sum_open_interest", 24))
        s.stage(oi_change_sma=s.mean("oi_change", 5), oi_price_divergence=F.col("oi_change") - F.col("_ret"))
    if s.has("long_short_ratio"):
        s.stage(
            ls_ratio_norm=F.col("long_short_ratio") - 1,
            ls_ratio_change=s.pct("long_short_ratio"),
            ls_ratio_zscore=s.zscore("long_short_ratio", 24),
        )
        s.stage(ls_ratio_sma=s.mean("ls_ratio_norm", 5))
    if s.has("long_account"):
        s.stage(long_pct=F.col("long_account"), short_pct=F.col("short_account"),
                long_short_diff=F.col("long_account") - F.col("short_account"))
    if s.has("buy_vol", "sell_vol"):
        both = F.col("buy_vol") + F.col("sell_vol")
        s.stage(
            taker_buy_sell_ratio=guarded("buy_vol", "sell_vol"),
            taker_buy_sell_diff=guarded(F.col("buy_vol") - F.col("sell_vol"), both),
            taker_vol_total=both,
        )
        s.stage(taker_vol_change=s.pct("taker_vol_total"))
    if s.has("premium_close"):
        s.stage(premium_norm=F.col("premium_close") * 100, premium_zscore=s.zscore("premium_close", 24))
        s.stage(premium_sma=s.mean("premium_norm", 8))
    if s.has("basis"):
        s.stage(basis_sma=s.mean("basis", 8), basis_zscore=s.zscore("basis", 24))
    return s


def price_action(s: Pieces, live: bool = False) -> Pieces:
    span = F.col("high") - F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    five_before = s.frame(-5, -1)
    full = F.col(s.pos) >= 5
    return s.stage(
        bar_position=guarded(F.col("close") - F.col("low"), span),
        bar_range_pct=ratio(span, "close"),
        bar_body_pct=ratio(F.abs(F.col("close") - F.col("open")), "close"),
        upper_shadow=guarded(F.col("high") - top, span),
        lower_shadow=guarded(bottom - F.col("low"), span),
        gap=div(F.col("open") - F.col("_prev"), "_prev", live),
        high_break=flag(full & (F.col("high") > F.max("high").over(five_before))),
        low_break=flag(full & (F.col("low") < F.min("low").over(five_before))),
    )


def momentum(s: Pieces, live: bool = False) -> Pieces:
    s.stage(**{f"_ema{k}": s.ewm("close", k, adjust=not live) for k in (3, 8, 13)},
            _lo5=s.min("low", 5), _hi5=s.max("high", 5), roc_3=s.pct("close", 3), roc_5=s.pct("close", 5))
    cross = lambda a, b: div(F.col(a) - F.col(b), b, live)
    s.stage(
        ema_cross_3_8=cross("_ema3", "_ema8"),
        ema_cross_3_13=cross("_ema3", "_ema13"),
        ema_cross_8_13=cross("_ema8", "_ema13"),
        price_vs_ema3=cross("close", "_ema3"),
        price_vs_ema8=cross("close", "_ema8"),
        stoch_k_5=guarded(F.col("close") - F.col("_lo5"), F.col("_hi5") - F.col("_lo5")) - 0.5,
    )
    return s.stage(stoch_d_5=s.mean("stoch_k_5", 3))


#: Feature order of the live short-horizon vector.
LIVE_FEATURES = [
    "log_return_1", "log_return_3", "log_return_5", "log_return_10", "cum_return_5", "cum_return_10",
    "rsi_5", "rsi_7", "rsi_14", "rsi_slope", "micro_vol_3", "micro_vol_5", "micro_vol_10", "vol_ratio_3_10",
    "atr_5", "atr_10", "atr_norm_5", "atr_norm_10", "atr_expansion", "volume_ratio_5", "volume_ratio_10",
    "volume_ratio_20", "volume_spike", "volume_trend", "volume_momentum", "bar_position", "bar_range_pct",
    "bar_body_pct", "upper_shadow", "lower_shadow", "gap", "high_break", "low_break", "ema_cross_3_8",
    "ema_cross_3_13", "ema_cross_8_13", "price_vs_ema3", "price_vs_ema8", "stoch_k_5", "stoch_d_5", "roc_3", "roc_5",
]


def scalp_features(bars: DataFrame, live: bool = False, rows: int | None = None) -> DataFrame:
    s = begin(bars, rows=rows)
    log_returns(s)
    rsi_set(s, live)
    micro_volatility(s)
    volume_spikes(s)
    if not live:
        order_flow(s)
    price_action(s, live)
    momentum(s, live)
    if not live:
        derivatives(s)
    return s.close()
