"""Whole feature builds: compose, label, fill, clip, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import materialize
from . import clean, intraday, labels, risk, scalp, swing

RAW = {
    "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote",
    "taker_buy_volume", "taker_buy_quote_volume", "buy_ratio", "target", "future_return", "open_time", "close_time",
    "timestamp", "datetime", "date", "time", "symbol", "timeframe", "buy_volume", "sell_volume", "trades_count",
    "funding_rate", "sum_open_interest", "sum_open_interest_value", "long_short_ratio", "long_account", "short_account",
    "buy_sell_ratio", "buy_vol", "sell_vol", "mark_open", "mark_high", "mark_low", "mark_close", "premium_open",
    "premium_high", "premium_low", "premium_close", "basis", "lastFundingRate", "open_interest", "ts", "pos", "n",
    "btc_return", "btc_dominance",
}

#: Helper columns an intraday model does not train on.
INTRADAY_HELPERS = {"sma_10", "sma_20", "sma_50", "vwap", "vwap_10", "vwap_20", "vwap_upper", "vwap_lower",
                    "bb_upper", "bb_lower"}

#: Helper columns a swing model does not train on.
SWING_HELPERS = {"sma_20", "sma_50", "sma_100", "sma_200", "high_20d", "low_20d", "high_50d", "low_50d", "regime",
                 "regime_duration", "ad_line"}

#: Explicit feature list of the leak-free and the compiled builds.
EXPLICIT = [
    "price_vs_sma10", "price_vs_sma20", "price_vs_sma50", "sma_cross_10_20", "sma_cross_10_50", "sma_cross_20_50",
    "trend_slope_10", "trend_slope_20", "ema_trend", "ema_trend_slope", "vwap_dev_10", "vwap_dev_20", "vwap_position",
    "volatility_10", "volatility_20", "volatility_50", "vol_ratio_10_50", "atr_14", "atr_norm", "bb_width", "bb_position",
    "rsi_14", "macd_norm", "macd_signal", "macd_hist_slope", "adx", "di_diff", "volume_ratio", "volume_trend",
    "obv_slope", "mfi", "funding_change", "funding_change_3", "funding_sma", "funding_vs_sma",
]


def feature_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    """Numeric columns that are neither raw input nor helper."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [n for n, t in df.dtypes if t in numeric and n not in RAW and n not in exclude]


def feature_table(bars: DataFrame, model: str, compat: bool = False, normalize: bool = True) -> tuple[DataFrame, list[str]]:
    """Features, label and optional per-symbol clip + scaling for ``scalp``, ``intraday`` or ``swing``.

    ``compat`` reproduces the published look-ahead habits: flat labels at the end of a series and
    back-filling at its start.
    """
    if model == "scalp":
        df, drop = scalp.scalp_features(bars), set()
    elif model == "intraday":
        df, drop = intraday.intraday_features(bars), INTRADAY_HELPERS
    else:
        df, drop = swing.swing_features(bars), SWING_HELPERS
    names = feature_columns(df, drop)
    horizon, threshold = labels.LABELS[model]
    df = labels.direction(df, horizon, threshold, fill_flat=compat)
    if model != "scalp":
        df = df.drop("future_return")
    # filling and scaling read the features several times
    df = clean.fill(materialize(df, f"{model}-features"), names, look_ahead=compat).filter(F.col("target").isNotNull())
    if normalize:
        df = materialize(df, f"{model}-filled")
        df = clean.standard_scale(clean.clip_outer(df, names), names)
        df = clean.zero_bad(df, names)
    return df, names


def leak_free_table(bars: DataFrame, train=None, horizon: int = 6, threshold: float = 0.01):
    """Explicit features without look-ahead; clip and scaling are fitted on ``train`` rows only."""
    df = labels.direction(intraday.intraday_features(bars), horizon, threshold).drop("future_return")
    df = clean.fill(materialize(df, "leak-free-features"), EXPLICIT).filter(F.col("target").isNotNull())
    if train is not None:
        df = materialize(df, "leak-free-filled")
        df = clean.clip_outer(df, EXPLICIT, fit=train)
        df = clean.standard_scale(df, EXPLICIT, fit=train)
    return df, EXPLICIT


def fast_table(bars: DataFrame, horizon: int = 6, threshold: float = 0.01):
    """The compiled form with flat labels at the end of the series."""
    df = labels.direction(intraday.intraday_features(bars, form="fast"), horizon, threshold, fill_flat=True)
    return clean.fill(df, EXPLICIT), EXPLICIT


def risk_table(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    df = labels.risk_score(risk.compact_features(bars))
    names = feature_columns(df, {"mae_long", "mae_short", "sl_hit_long", "sl_hit_short", "max_adverse_excursion",
                                 "stop_loss_hit", "volatility_spike", "risk_score"})
    return df.dropna(subset=[*names, "risk_score"]), names
