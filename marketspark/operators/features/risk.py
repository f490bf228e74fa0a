"""Risk feature sets: the compact first form, the ten-part second form, the lazy pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import begin, div, flag, guarded, ratio, rsi, zeros
from ...functions.series import Pieces, clip



def _root252() -> Column:
    return F.sqrt(F.lit(252.0))


# ------------------------------------------------------------------ first form


def compact(s: Pieces, live: bool = False) -> Pieces:
    s.stage(**{f"volatility_{k}": s.vol("_ret", k) for k in (5, 10, 20, 50)},
            atr_14=s.mean("_tr", 14), atr_50=s.mean("_tr", 50), _v20=s.mean("volume", 20), _v50=s.mean("volume", 50),
            _s20=s.mean("close", 20), _s50=s.mean("close", 50), _r20=s.pct("close", 20), _peak=s.max("close", 50),
            _rsi=rsi(s, 14, live), _l1=s.lag("_ret"))
    c, r20 = F.col("close"), F.col("_r20")
    s.stage(
        vol_ratio_5_20=guarded("volatility_5", "volatility_20"), vol_ratio_10_50=guarded("volatility_10", "volatility_50"),
        atr_norm=div("atr_14", "close", live), atr_ratio=guarded("atr_14", "atr_50"),
        volume_ratio=guarded("volume", "_v20"), volume_trend=guarded("_v20", "_v50") - 1,
        trend_strength=div(F.col("_s20") - F.col("_s50"), "_s50", live),
        price_vs_sma20=div(c - F.col("_s20"), "_s20", live), price_vs_sma50=div(c - F.col("_s50"), "_s50", live),
        regime_bull=flag(r20 > 0.05), regime_bear=flag(r20 < -0.05), regime_flat=flag((r20 >= -0.05) & (r20 <= 0.05)),
        drawdown=div(c - F.col("_peak"), "_peak", live),
        bar_range=div(F.col("high") - F.col("low"), c, live),
        gap=div(F.abs(F.col("open") - F.col("_prev")), "_prev", live),
        rsi_14=F.col("_rsi") / 100 - 0.5 if live else (F.col("_rsi") - 50) / 50,
        rsi_extreme_high=flag(F.col("_rsi") > 80), rsi_extreme_low=flag(F.col("_rsi") < 20),
        return_autocorr=s.autocorr("_ret", "_l1", 20, 1),
    )
    s.stage(low_liquidity=flag(F.col("volume_ratio") < 0.5), gap_risk=flag(F.col("gap") > 0.01), _depth=F.abs("drawdown"))
    return s.stage(drawdown_depth=s.max("_depth", 10) if live else F.col("_depth"))


def model_inputs(s: Pieces) -> Pieces:
    """Confidence and uncertainty from joined predictions, or neutral placeholders."""
    if s.has("P_up", "P_down"):
        top = F.greatest("P_up", "P_down")
        conf = F.coalesce("confidence", top) if s.has("confidence") else top
        return s.stage(model_confidence=conf, model_P_up=F.col("P_up"), model_P_down=F.col("P_down"), model_uncertainty=1 - top)
    return s.stage(model_confidence=F.lit(0.5), model_P_up=F.lit(0.33), model_P_down=F.lit(0.33), model_uncertainty=F.lit(0.5))


def derivatives_pressure(s: Pieces) -> Pieces:
    """Crowding, funding, open-interest, taker and premium risk with their blended score."""
    if s.has("funding_rate"):
        s.stage(_fr=F.coalesce("funding_rate", F.lit(0.0)))
        s.stage(funding_zscore=s.zscore("_fr", 100), funding_risk=F.abs("_fr") * 100, funding_cumsum_risk=F.abs(s.sum("_fr", 24)))
        s.stage(funding_extreme=flag(F.abs("funding_zscore") > 2))
    else:
        zeros(s, "funding_zscore", "funding_extreme", "funding_risk", "funding_cumsum_risk")
    if s.has("sum_open_interest"):
        s.expanding(_oi=("last", F.col("sum_open_interest")))
        s.stage(_oc=s.pct("_oi"), oi_zscore=s.zscore("_oi", 100))
        s.stage(oi_change_risk=clip(F.abs("_oc"), 0.0, 0.5), oi_extreme_high=flag(F.col("oi_zscore") > 2),
                oi_dropping_fast=flag(F.col("_oc") < -0.05))
    else:
        zeros(s, "oi_change_risk", "oi_zscore", "oi_extreme_high", "oi_dropping_fast")
    if s.has("long_short_ratio"):
        s.stage(_ls=F.coalesce("long_short_ratio", F.lit(1.0)))
        s.stage(ls_zscore=s.zscore("_ls", 100), crowd_long_risk=flag(F.col("_ls") > 2.5), crowd_short_risk=flag(F.col("_ls") < 0.67))
        s.stage(crowded_trade=F.greatest("crowd_long_risk", "crowd_short_risk"))
    else:
        zeros(s, "ls_zscore", "crowd_long_risk", "crowd_short_risk", "crowded_trade")
    if s.has("buy_sell_ratio"):
        b = F.coalesce("buy_sell_ratio", F.lit(1.0))
        s.stage(taker_imbalance=F.abs(b - 1), aggressive_selling=flag(b < 0.8), aggressive_buying=flag(b > 1.2))
    else:
        zeros(s, "taker_imbalance", "aggressive_selling", "aggressive_buying")
    if s.has("lastFundingRate"):
        p = F.coalesce("lastFundingRate", F.lit(0.0))
        s.stage(basis_risk=F.abs(p) * 1000, high_premium=flag(F.abs(p) > 0.001))
    else:
        zeros(s, "basis_risk", "high_premium")
    score = 0.2 * (F.col("funding_extreme") + F.col("oi_extreme_high") + F.col("crowded_trade")
                   + clip("taker_imbalance", 0.0, 1.0) + F.col("high_premium"))
    return s.stage(derivatives_risk=clip(score, 0.0, 1.0))


def compact_features(bars: DataFrame, live: bool = False, rows: int | None = None) -> DataFrame:
    s = begin(bars, rows=rows)
    compact(s, live)
    model_inputs(s)
    if not live:
        derivatives_pressure(s)
    return s.close()


#: Feature order of the live risk vector.
LIVE_FEATURES = [
    "volatility_5", "volatility_10", "volatility_20", "volatility_50", "vol_ratio_5_20", "vol_ratio_10_50", "atr_14",
    "atr_50", "atr_norm", "atr_ratio", "volume_ratio", "volume_trend", "low_liquidity", "trend_strength",
    "price_vs_sma20", "price_vs_sma50", "regime_bull", "regime_bear", "regime_flat", "drawdown", "drawdown_depth",
    "bar_range", "gap", "gap_risk", "rsi_14", "rsi_extreme_high", "rsi_extreme_low", "model_confidence", "model_P_up",
    "model_P_down", "model_uncertainty", "return_autocorr",
]


# ------------------------------------------------------------------ second form


def volatility_regime(s: Pieces, windows=(5, 10, 20, 50, 100)) -> Pieces:
    s.stage(**{f"volatility_{k}": s.vol("_ret", k) for k in windows}, atr_14=s.mean("_tr", 14), atr_50=s.mean("_tr", 50))
    s.stage(
        **{f"vol_ratio_{a}_{b}": guarded(f"volatility_{a}", f"volatility_{b}") for a, b in ((5, 20), (10, 50), (20, 100))},
        vol_zscore=s.zscore("volatility_20", 100), vol_change=s.pct("volatility_5"), vol_momentum=s.diff("volatility_5", 5),
        vol_clustering=s.hits(F.abs("_ret") > F.col("volatility_20") * 2, 10),
        atr_norm=ratio("atr_14", "close"), atr_ratio=guarded("atr_14", "atr_50"),
    )
    return s.stage(vol_regime_high=flag(F.col("vol_zscore") > 1), vol_regime_low=flag(F.col("vol_zscore") < -1))


def tail_risk(s: Pieces) -> Pieces:
    s.moments("_ret", 20, 50, 100)
    s.stage(**{f"kurtosis_{k}": s.kurt("_ret", k) for k in (20, 50, 100)},
            **{f"skewness_{k}": s.skew("_ret", k) for k in (20, 50, 100)},
            **{f"_pk{k}": s.max("close", k) for k in (20, 50, 100)},
            _sd50=s.vol("_ret", 50), var_95_50=s.quantile("_ret", 0.05, 50), var_99_50=s.quantile("_ret", 0.01, 50),
            cvar_95_50=s.tail_mean("_ret", 0.05, 50))
    s.stage(extreme_positive=s.hits(F.col("_ret") > F.col("_sd50") * 2.5, 20),
            extreme_negative=s.hits(F.col("_ret") < -F.col("_sd50") * 2.5, 20),
            **{f"_d{k}": ratio(F.col("close") - F.col(f"_pk{k}"), f"_pk{k}") for k in (20, 50, 100)})
    return s.stage(extreme_ratio=F.col("extreme_negative") / (F.col("extreme_positive") + 1),
                   **{f"max_dd_{k}": s.min(f"_d{k}", k) for k in (20, 50, 100)})


def liquidity(s: Pieces) -> Pieces:
    s.stage(**{f"_v{k}": s.mean("volume", k) for k in (5, 10, 20, 50)}, _vc=s.pct("volume"))
    s.stage(**{f"volume_ratio_{k}": guarded("volume", f"_v{k}") for k in (5, 10, 20, 50)},
            volume_trend=guarded("_v5", "_v20") - 1, volume_trend_long=guarded("_v20", "_v50") - 1,
            volume_volatility=s.std("_vc", 20),
            illiquidity=guarded(F.abs("_ret"), F.col("volume") * F.col("close")) * 1e9,
            spread_proxy=ratio(F.col("high") - F.col("low"), "close"))
    s.stage(illiquidity_sma=s.mean("illiquidity", 20), spread_proxy_sma=s.mean("spread_proxy", 20),
            low_liquidity=flag(F.col("volume_ratio_20") < 0.5), very_low_liquidity=flag(F.col("volume_ratio_20") < 0.25))
    return s.stage(spread_expansion=guarded("spread_proxy", "spread_proxy_sma"))


def regime(s: Pieces) -> Pieces:
    """Averages longer than the series are absent; here they are null."""
    s.stage(**{f"_s{k}": s.mean("close", k) for k in (20, 50, 100, 200)}, _r20=s.pct("close", 20),
            _h20=s.max("high", 20), _l20=s.min("low", 20))
    c, r20 = F.col("close"), F.col("_r20")
    s.stage(**{f"price_vs_sma_{k}": ratio(c - F.col(f"_s{k}"), f"_s{k}") for k in (20, 50, 100, 200)},
            trend_strength=ratio(F.col("_s20") - F.col("_s50"), "_s50"),
            regime_bull=flag(r20 > 0.05), regime_bear=flag(r20 < -0.05), regime_flat=flag((r20 >= -0.05) & (r20 <= 0.05)),
            near_high=flag(c >= F.col("_h20") * 0.98), near_low=flag(c <= F.col("_l20") * 1.02),
            range_position=guarded(c - F.col("_l20"), F.col("_h20") - F.col("_l20")))
    return s.stage(trend_direction=F.signum("trend_strength"), mean_reversion_potential=F.abs("price_vs_sma_20"))


def correlation(s: Pieces) -> Pieces:
    s.stage(**{f"_lag{k}": s.lag("_ret", k) for k in (1, 5, 10)}, _vch=s.pct("volume"),
            _hl=ratio(F.col("high") - F.col("low"), "close"), _m5=s.pct("close", 5), _m20=s.pct("close", 20))
    return s.stage(
        **{f"return_autocorr_{k}": s.autocorr("_ret", f"_lag{k}", 50, k) for k in (1, 5, 10)},
        vol_return_corr=s.corr("_ret", "_vch", 20), range_return_corr=s.corr("_ret", "_hl", 20),
        momentum_consistency=flag(F.signum("_m5") == F.signum("_m20")),
    )


def degradation(s: Pieces) -> Pieces:
    up = F.col("_ret") > 0
    s.stage(**{f"sharpe_{k}": guarded(s.mean("_ret", k), s.vol("_ret", k)) * _root252() for k in (20, 50, 100)},
            _z100=s.zscore("_ret", 100), hit_rate_20=s.hit_rate(up, 20), hit_rate_50=s.hit_rate(up, 50))
    return s.stage(sharpe_degradation=F.col("sharpe_20") - F.col("sharpe_100"), ir_stability=s.std("sharpe_20", 20),
                   regime_break_indicator=s.hits(F.abs("_z100") > 3, 10),
                   hit_rate_drift=F.col("hit_rate_20") - F.col("hit_rate_50"))


def drawdown(s: Pieces) -> Pieces:
    """Drawdown from the running peak, with the length of the current one."""
    s.expanding(_peak=("max", F.col("close")))
    s.stage(drawdown=ratio(F.col("close") - F.col("_peak"), "_peak"))
    s.expanding(_top=("max", F.when(~(F.col("drawdown") < 0), F.col(s.pos))))
    return s.stage(drawdown_depth=F.abs("drawdown"), dd_duration=(F.col(s.pos) - F.col("_top")),
                   recovery_speed=s.diff("drawdown"), underwater=flag(F.col("drawdown") < -0.05),
                   deep_underwater=flag(F.col("drawdown") < -0.10))


def derivatives(s: Pieces) -> Pieces:
    if s.has("funding_rate"):
        s.stage(funding_rate_norm=F.col("funding_rate") * 1000, funding_rate_sma=s.mean("funding_rate", 8) * 1000,
                funding_rate_extreme=flag(F.abs("funding_rate") > 0.001), funding_rate_zscore=s.zscore("funding_rate", 24))
    if s.has("open_interest"):
        s.stage(oi_change=s.pct("open_interest"), oi_momentum=s.pct("open_interest", 24))
        s.stage(oi_change_sma=s.mean("oi_change", 12))
    if s.has("long_short_ratio"):
        ls = F.col("long_short_ratio")
        s.stage(ls_ratio_norm=ls - 1, ls_ratio_extreme_long=flag(ls > 2), ls_ratio_extreme_short=flag(ls < 0.5))
    return s


def model_predictions(s: Pieces) -> Pieces:
    """Columns from joined model output; absent predictions give neutral values."""
    if not s.has("P_up", "P_down"):
        return s.stage(model_confidence=F.lit(0.5), model_uncertainty=F.lit(0.5), model_signal_strength=F.lit(0.0))
    s.stage(model_P_up=F.col("P_up"), model_P_down=F.col("P_down"), model_uncertainty=1 - F.greatest("P_up", "P_down"),
            model_signal_strength=F.col("P_up") - F.col("P_down"))
    if s.has("confidence"):
        s.stage(model_confidence=F.col("confidence"))
    if s.has("expected_return"):
        s.stage(model_expected_return=F.col("expected_return"))
    return s


PARTS = {
    "drawdown": drawdown, "volatility": volatility_regime, "tail": tail_risk, "liquidity": liquidity, "regime": regime,
    "correlation": correlation, "degradation": degradation, "derivatives": derivatives,
    "model": model_predictions,
}


def advanced_features(bars: DataFrame, parts=tuple(PARTS), rows: int | None = None) -> DataFrame:
    s = begin(bars, rows=rows)
    for part in parts:
        PARTS[part](s)
    return s.close()


# ------------------------------------------------------------------ lazy pair


def lazy_features(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Realized volatility, population skew, drawdown share and rolling 5 % quantile."""
    s = begin(bars, rows=rows)
    s.expanding(_peak=("max", F.col("close")))
    s.moments("_ret", 20)
    return s.stage(
        realized_vol_20=s.vol("_ret", 20) * _root252(), realized_vol_60=s.vol("_ret", 60) * _root252(),
        skewness_20=s.skew("_ret", 20, bias=True),
        drawdown=guarded(F.col("_peak") - F.col("close"), "_peak"),
        rolling_var_95=s.quantile("_ret", 0.05, 60),
    ).close()
