"""Intraday features in three published forms.

``batch`` is the training form, ``live`` the panel form (seeded averages, guarded ratios,
slope including the current close), ``fast`` the compiled form (population deviation,
Wilder RSI, averaged true range by EMA, n-th order differences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.series import Pieces
from .base import begin, flag, guarded, ratio, rsi, zeros

FORMS = ("batch", "live", "fast")


def _div(a, b, form):
    return ratio(a, b) if form == "batch" else guarded(a, b)


def _zero_head(c, s: Pieces, k: int):
    return F.when(F.col(s.pos) < k, F.lit(0.0)).otherwise(c)


def trend(s: Pieces, form: str = "batch") -> Pieces:
    seeded = form != "batch"
    s.stage(**{f"sma_{k}": s.mean("close", k) for k in (10, 20, 50)},
            _e12=s.ewm("close", 12, not seeded), _e26=s.ewm("close", 26, not seeded),
            **{f"_slope{k}": s.slope("close", k) for k in (10, 20)})
    s.stage(
        **{f"price_vs_sma{k}": _div(F.col("close") - F.col(f"sma_{k}"), f"sma_{k}", form) for k in (10, 20, 50)},
        **{f"sma_cross_{a}_{b}": _div(f"sma_{a}", f"sma_{b}", form) - 1 for a, b in ((10, 20), (10, 50), (20, 50))},
        ema_trend=_div(F.col("_e12") - F.col("_e26"), "_e26", form),
    )
    for k in (10, 20):
        if form == "batch":  # the k closes before the current one
            s.stage(**{f"trend_slope_{k}": _zero_head(ratio(s.lag(f"_slope{k}"), "close"), s, k)})
        elif form == "fast":
            s.stage(**{f"trend_slope_{k}": _zero_head(ratio(f"_slope{k}", "close"), s, k - 1)})
        else:
            s.stage(**{f"trend_slope_{k}": ratio(f"_slope{k}", "close")})
    if form == "fast":
        return s.stage(ema_trend_slope=_zero_head(s.nth_diff("ema_trend", 5), s, 5))
    return s.stage(ema_trend_slope=s.diff("ema_trend", 5))


def running_totals(s: Pieces, form: str = "batch") -> Pieces:
    """On-balance volume and the sums behind the cumulative VWAP.  They come first in a build: their
    summary pass then reads raw bars only."""
    step = F.signum("_delta") * F.col("volume")
    s.stage(_tpv=F.col("_tp") * F.col("volume"))
    sums = {"_obv": ("sum", F.coalesce(step, F.lit(0.0)) if form == "fast" else step)}
    if form == "batch":
        sums |= {"_cv": ("sum", F.col("volume").cast("double")), "_ctpv": ("sum", F.col("_tpv"))}
    return s.expanding(**sums)


def vwap(s: Pieces, form: str = "batch") -> Pieces:
    if form == "batch":
        s.stage(vwap=ratio("_ctpv", "_cv"))
    std = s.std0 if form == "fast" else s.std
    s.stage(**{f"vwap_{k}": (guarded if form == "live" else ratio)(s.sum("_tpv", k), s.sum("volume", k)) for k in (10, 20)},
            _sd20=std("close", 20), _mid20=s.mean("close", 20))
    mid = F.col("_mid20") if form == "live" else F.col("vwap_20")
    s.stage(vwap_upper=mid + 2 * F.col("_sd20"), vwap_lower=mid - 2 * F.col("_sd20"))
    return s.stage(
        **{f"vwap_dev_{k}": _div(F.col("close") - F.col(f"vwap_{k}"), f"vwap_{k}", form) for k in (10, 20)},
        vwap_position=guarded(F.col("close") - F.col("vwap_lower"), F.col("vwap_upper") - F.col("vwap_lower")),
    )


def funding(s: Pieces, form: str = "batch") -> Pieces:
    if form == "live" or not s.has("funding_rate"):
        return zeros(s, "funding_change", "funding_change_3", "funding_sma", "funding_vs_sma",
                     *([] if form == "fast" else ["funding_extreme_pos", "funding_extreme_neg"]),
                     *(["funding_zscore"] if form == "batch" else []))
    fr = F.col("funding_rate")
    mean8 = s.mean("funding_rate", 8)
    if form == "fast":
        return s.stage(
            funding_change=_zero_head(s.diff(fr), s, 1) * 1000,
            funding_change_3=_zero_head(s.nth_diff(fr, 3), s, 3) * 1000,
            funding_sma=mean8 * 1000, funding_vs_sma=(fr - mean8) * 1000)
    return s.stage(
        funding_change=s.diff(fr) * 1000, funding_change_3=s.diff(fr, 3) * 1000,
        funding_sma=mean8 * 1000, funding_vs_sma=(fr - mean8) * 1000,
        funding_extreme_pos=flag(fr > 0.001), funding_extreme_neg=flag(fr < -0.001),
        funding_zscore=s.zscore(fr, 24),
    )


def open_interest(s: Pieces, column: str = "sum_open_interest") -> Pieces:
    if not s.has(column):
        return zeros(s, "oi_change", "oi_change_3", "oi_change_10", "oi_vs_sma", "oi_momentum", "price_oi_corr", "oi_zscore")
    s.stage(oi_change=s.pct(column), oi_change_3=s.pct(column, 3), oi_change_10=s.pct(column, 10),
            oi_vs_sma=guarded(column, s.mean(column, 10)) - 1, oi_zscore=s.zscore(column, 24))
    return s.stage(oi_momentum=s.diff("oi_change"), price_oi_corr=s.corr("_ret", "oi_change", 10))


def long_short(s: Pieces) -> Pieces:
    if not s.has("long_short_ratio"):
        return zeros(s, "ls_ratio_norm", "ls_ratio_sma", "ls_ratio_change", "ls_ratio_zscore", "long_short_diff")
    s.stage(ls_ratio_norm=F.col("long_short_ratio") - 1, ls_ratio_change=s.pct("long_short_ratio"),
            ls_ratio_zscore=s.zscore("long_short_ratio", 24))
    if s.has("long_account"):
        s.stage(long_short_diff=F.col("long_account") - F.col("short_account"))
    return s.stage(ls_ratio_sma=s.mean("ls_ratio_norm", 8))


def taker(s: Pieces) -> Pieces:
    if not s.has("buy_sell_ratio"):
        return zeros(s, "taker_ratio_norm", "taker_ratio_sma", "taker_imbalance", "taker_vol_change")
    s.stage(taker_ratio_norm=F.col("buy_sell_ratio") - 1)
    s.stage(taker_ratio_sma=s.mean("taker_ratio_norm", 8))
    if s.has("buy_vol"):
        s.stage(_tv=F.col("buy_vol") + F.col("sell_vol"))
        s.stage(taker_imbalance=guarded(F.col("buy_vol") - F.col("sell_vol"), "_tv"), taker_vol_change=s.pct("_tv"))
    return s


def premium(s: Pieces) -> Pieces:
    if s.has("premium_close"):
        s.stage(premium_norm=F.col("premium_close") * 100, premium_zscore=s.zscore("premium_close", 24))
        s.stage(premium_sma=s.mean("premium_norm", 8))
    else:
        zeros(s, "premium_norm", "premium_sma", "premium_zscore")
    if s.has("basis"):
        return s.stage(basis_sma=s.mean("basis", 8), basis_zscore=s.zscore("basis", 24))
    return zeros(s, "basis_sma", "basis_zscore")


def benchmark_relation(s: Pieces, own: str | None = None) -> Pieces:
    """Relation to a benchmark return joined on beforehand as ``btc_return``.

    ``own`` is the benchmark's own symbol: live panels report 1/1/0/1 for it.
    """
    names = ("btc_corr_10", "btc_corr_20", "relative_strength", "btc_beta")
    if not s.has("btc_return"):
        zeros(s, "btc_return", *names[:3])
        return zeros(s, "btc_beta", value=1.0)
    b = F.col("btc_return")
    values = (s.corr("_ret", b, 10), s.corr("_ret", b, 20), s.mean("_ret", 10) - s.mean(b, 10),
              guarded(s.cov("_ret", b, 20), s.var(b, 20)))
    if own is None:
        return s.stage(**dict(zip(names, values)))
    return s.stage(**{n: F.when(F.col("symbol") == own, F.lit(c)).otherwise(v)
                      for n, c, v in zip(names, (1.0, 1.0, 0.0, 1.0), values)})


def volatility(s: Pieces, form: str = "batch") -> Pieces:
    fast = form == "fast"
    std = s.std0 if fast else s.std
    vol = s.std0 if fast else s.vol
    s.stage(_r=F.coalesce("_ret", F.lit(0.0)) if fast else F.col("_ret"))
    s.stage(**{f"volatility_{k}": vol("_r", k) for k in (10, 20, 50)},
            atr_14=s.ewm("_tr", 14, adjust=False) if fast else s.mean("_tr", 14),
            _mid=s.mean("close", 20), _sd=std("close", 20))
    s.stage(bb_upper=F.col("_mid") + 2 * F.col("_sd"), bb_lower=F.col("_mid") - 2 * F.col("_sd"),
            vol_ratio_10_50=guarded("volatility_10", "volatility_50"),
            atr_norm=guarded("atr_14", "close") if fast else ratio("atr_14", "close"))
    return s.stage(bb_width=_div(F.col("bb_upper") - F.col("bb_lower"), "_mid", form),
                   bb_position=guarded(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))


def macd(s: Pieces, seeded: bool) -> Pieces:
    s.stage(_m12=s.ewm("close", 12, not seeded), _m26=s.ewm("close", 26, not seeded))
    s.stage(_macd=F.col("_m12") - F.col("_m26"))
    return s.stage(_sig=s.ewm("_macd", 9, not seeded))


def wilder_rsi(s: Pieces, period: int = 14):
    """RSI by Wilder smoothing; the first bar counts as a change of zero."""
    s.stage(_g=F.coalesce("_gain", F.lit(0.0)), _l=F.coalesce("_loss", F.lit(0.0)))
    s.stage(_gs=s.mean("_g", period), _ls=s.mean("_l", period))
    alpha = 1.0 / period
    p = F.col(s.pos)

    def smooth(x, seed):
        return s._decayed(F.when(p == period - 1, F.col(seed) / alpha).when(p >= period, F.col(x)).otherwise(F.lit(0.0)), alpha)

    s.stage(_ag=smooth("_g", "_gs"), _al=smooth("_l", "_ls"))
    value = F.when(F.col("_al") == 0, F.lit(100.0)).otherwise(100 - ratio(F.lit(100.0), 1 + ratio("_ag", "_al")))
    return F.when(p >= period - 1, value)


def directional(s: Pieces, form: str = "batch") -> Pieces:
    """ADX and DI difference."""
    s.stage(_up=s.diff("high"), _dn=-s.diff("low"))
    up, dn = F.col("_up"), F.col("_dn")
    s.stage(_pdm=F.when((up > dn) & (up > 0), up).otherwise(F.lit(0.0)),
            _mdm=F.when((dn > up) & (dn > 0), dn).otherwise(F.lit(0.0)))
    s.stage(_a14=s.mean("_tr", 14), _p14=s.mean("_pdm", 14), _n14=s.mean("_mdm", 14))
    s.stage(_pdi=100 * _div("_p14", "_a14", form), _mdi=100 * _div("_n14", "_a14", form))
    s.stage(_dx=100 * guarded(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")))
    return s.stage(adx=s.mean("_dx", 14) / 100, di_diff=(F.col("_pdi") - F.col("_mdi")) / 100)


def momentum(s: Pieces, form: str = "batch") -> Pieces:
    value = wilder_rsi(s) if form == "fast" else rsi(s, 14, form == "live")
    s.stage(rsi_14=value / 100 - 0.5)
    macd(s, form != "batch")
    s.stage(macd_norm=_div("_macd", "close", form), macd_signal=_div(F.col("_macd") - F.col("_sig"), "close", form))
    if form == "fast":
        s.stage(macd_hist_slope=_zero_head(s.nth_diff("macd_signal", 3), s, 3))
    else:
        s.stage(macd_hist_slope=s.diff("macd_signal", 3))
    return directional(s, form)


def volume(s: Pieces, form: str = "batch") -> Pieces:
    s.stage(_s10=s.mean("volume", 10), _s20=s.mean("volume", 20), _ptp=s.lag("_tp"))
    s.stage(volume_ratio=guarded("volume", "_s20"), volume_trend=guarded("_s10", "_s20") - 1)
    mean = s.mean("_obv", 10)
    if form == "fast":
        # differences of the series preceded by ten zeros
        terms = [F.coalesce(s.lag("_obv", i) if i else F.col("_obv"), F.lit(0.0)) for i in range(11)]
        change = sum((F.lit(float((-1) ** i * _BINOMIAL_10[i])) * t for i, t in enumerate(terms)), F.lit(0.0))
    else:
        change = s.diff("_obv", 10)
    s.stage(obv_slope=guarded(change, F.abs(mean) if form == "live" else mean))
    flow, tp, prev = F.col("_tp") * F.col("volume"), F.col("_tp"), F.col("_ptp")
    s.stage(_pf=F.when(tp > prev, flow).otherwise(F.lit(0.0)), _nf=F.when(tp < prev, flow).otherwise(F.lit(0.0)))
    money = guarded(s.sum("_pf", 14), s.sum("_nf", 14))
    return s.stage(mfi=(100 - ratio(F.lit(100.0), 1 + money)) / 100 - 0.5)


#: Binomial coefficients of order ten.
_BINOMIAL_10 = [1, 10, 45, 120, 210, 252, 210, 120, 45, 10, 1]

#: Feature order of the live intraday vector.
LIVE_FEATURES = [
    "price_vs_sma10", "price_vs_sma20", "price_vs_sma50", "sma_cross_10_20", "sma_cross_10_50", "sma_cross_20_50",
    "trend_slope_10", "trend_slope_20", "ema_trend", "ema_trend_slope", "vwap_dev_10", "vwap_dev_20", "vwap_position",
    "funding_change", "funding_change_3", "funding_sma", "funding_vs_sma", "funding_extreme_pos", "funding_extreme_neg",
    "oi_change", "oi_change_3", "oi_change_10", "oi_vs_sma", "oi_momentum", "price_oi_corr",
    "btc_corr_10", "btc_corr_20", "relative_strength", "btc_beta", "volatility_10", "volatility_20", "volatility_50",
    "vol_ratio_10_50", "atr_14", "atr_norm", "bb_width", "bb_position", "rsi_14", "macd_norm", "macd_signal",
    "macd_hist_slope", "adx", "di_diff", "volume_ratio", "volume_trend", "obv_slope", "mfi",
]


def intraday_features(bars: DataFrame, form: str = "batch", own: str | None = None, rows: int | None = None) -> DataFrame:
    """All intraday columns; derivative inputs are used when the table carries them."""
    s = running_totals(begin(bars, rows=rows), form)
    trend(s, form)
    vwap(s, form)
    funding(s, form)
    if form == "live":
        zeros(s, "oi_change", "oi_change_3", "oi_change_10", "oi_vs_sma", "oi_momentum", "price_oi_corr")
    if form == "batch":
        open_interest(s)
        long_short(s)
        taker(s)
        premium(s)
    if form != "fast":
        benchmark_relation(s, own)
    volatility(s, form)
    momentum(s, form)
    volume(s, form)
    return s.close()
