"""Long-horizon features whose window lengths depend on the length of the series.

A window's length is a column, so short and long series take the same plan; such windows come from one
pass over each piece at a cost that does not depend on their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import begin, div, flag, guarded, ratio, rsi, zeros
from .intraday import macd
from ...functions.series import Pieces


def _least(a, b):
    return F.least(F.lit(a), b).cast("int")


def _most(a, b):
    return F.greatest(F.lit(a), b).cast("int")


def _part(n, d: int):
    return F.floor(n / d).cast("int")


def moving_averages(s: Pieces, n, live: bool = False) -> Pieces:
    if live:
        m = _most(10, _part(n, 5))
        width = {w: _least(w, m * (w // 20 + 1)) for w in (20, 50, 100, 200)}
    else:
        m = _least(20, _part(n, 3))
        width = {20: _least(20, m), 50: _least(50, m * 2), 100: _least(100, m * 4), 200: _least(200, m * 6)}
    s.stage(**{f"sma_{w}": s.mean("close", k) for w, k in width.items()})
    s.stage(_p50=s.lag("sma_50"), _p200=s.lag("sma_200"), sma50_slope=s.pct("sma_50", 5), sma200_slope=s.pct("sma_200", 10))
    a, b = F.col("sma_50"), F.col("sma_200")
    return s.stage(
        **{f"price_vs_sma{w}": div(F.col("close") - F.col(f"sma_{w}"), f"sma_{w}", live) for w in width},
        **{f"ma_cross_{x}_{y}": div(f"sma_{x}", f"sma_{y}", live) - 1 for x, y in ((20, 50), (50, 100), (50, 200), (100, 200))},
        golden_cross=flag((a > b) & (F.col("_p50") <= F.col("_p200"))),
        death_cross=flag((a < b) & (F.col("_p50") >= F.col("_p200"))),
        ma_spread=div(a - b, b, live),
    )


def regime(s: Pieces, n, live: bool = False) -> Pieces:
    """Bull / bear / flat with run length; ±2 % and ordered averages."""
    if live:
        m = _most(5, _part(n, 10))
        s.stage(_a50=s.mean("close", _least(50, m * 4)), _a200=s.mean("close", _least(200, m * 8)),
                return_20d=s.pct("close", _least(20, m * 2)), return_50d=s.pct("close", _least(50, m * 4)))
    else:
        s.stage(_a50=F.col("sma_50"), _a200=F.col("sma_200"), return_20d=s.pct("close", 20), return_50d=s.pct("close", 50))
    c, a, b, r = (F.col(x) for x in ("close", "_a50", "_a200", "return_20d"))
    s.stage(regime=F.when((c > a) & (a > b) & (r > 0.02), F.lit(1)).when((c < a) & (a < b) & (r < -0.02), F.lit(-1)).otherwise(F.lit(0)))
    s.stage(_pr=s.lag("regime"))
    start = F.when(F.col("_pr").isNull() | (F.col("regime") != F.col("_pr")), F.col(s.pos))
    s.expanding(_since=("max", start))
    return s.stage(
        regime_bull=flag(F.col("regime") == 1), regime_bear=flag(F.col("regime") == -1), regime_flat=flag(F.col("regime") == 0),
        regime_duration=F.col(s.pos) - F.col("_since") + 1,
        regime_duration_norm=(F.col(s.pos) - F.col("_since") + 1) / 50.0,
    )


def levels(s: Pieces, n, live: bool = False) -> Pieces:
    """Volatilities and mean volumes, which further windows look at."""
    m = _most(5, _part(n, 10))
    if live:
        k = {20: _least(20, m), 50: _least(50, m * 2), 100: _least(100, m * 5)}
    else:
        k = {20: _least(20, m * 2), 50: _least(50, m * 4), 100: _least(100, m * 8)}
    return s.stage(**{f"volatility_{w}": s.std("_ret", x) for w, x in k.items()}, _v10=s.mean("volume", _least(10, m)), _v50=s.mean("volume", _least(50, m * 4)))


def macro_volatility(s: Pieces, n, live: bool = False) -> Pieces:
    m = _most(5, _part(n, 10))
    if live:
        k_med, k14, k50, k_dd = _least(100, m * 8), _least(14, m), _least(50, m * 4), _least(50, m * 4)
    else:
        k_med, k14, k50, k_dd = (_least(100, _part(n, 3)), _least(14, _part(n, 5)), _least(50, _part(n, 3)), _least(50, _part(n, 3)))
    s.stage(atr_14=s.mean("_tr", k14), atr_50=s.mean("_tr", k50), _peak=s.max("close", k_dd),
            _mid=s.mean("close", 20), _sd=s.std("close", 20))
    s.stage(_med=s.median("volatility_50", k_med))
    s.stage(
        volatility_annual=F.col("volatility_20") * F.sqrt(F.lit(365.0)),
        vol_regime=guarded("volatility_20", "_med"),
        atr_norm=div("atr_14", "close", live), atr_ratio=guarded("atr_14", "atr_50"),
        bb_width=div(4 * F.col("_sd"), "_mid", live),
        drawdown=div(F.col("close") - F.col("_peak"), "_peak", live),
    )
    return s.stage(high_vol_flag=flag(F.col("vol_regime") > 1.5), low_vol_flag=flag(F.col("vol_regime") < 0.7))


def dominance(s: Pieces) -> Pieces:
    """Market-wide share series joined on beforehand as ``btc_dominance``."""
    if not s.has("btc_dominance"):
        zeros(s, "btc_dominance", value=50.0)
        return zeros(s, "dominance_change_5d", "dominance_change_20d", "dominance_vs_sma", "dominance_rising", "dominance_falling")
    s.stage(dominance_change_5d=s.pct("btc_dominance", 5), dominance_change_20d=s.pct("btc_dominance", 20),
            dominance_vs_sma=ratio("btc_dominance", s.mean("btc_dominance", 20)) - 1)
    return s.stage(dominance_rising=flag(F.col("dominance_change_5d") > 0.01),
                   dominance_falling=flag(F.col("dominance_change_5d") < -0.01))


def momentum(s: Pieces, live: bool = False) -> Pieces:
    s.stage(rsi_14=rsi(s, 14, live) / 100 - 0.5, rsi_7=rsi(s, 7, live) / 100 - 0.5,
            **{f"roc_{k}": s.pct("close", k) for k in (10, 20, 50)}, price_momentum=s.pct("close", 20))
    macd(s, live)
    return s.stage(macd_norm=div("_macd", "close", live), macd_signal=div(F.col("_macd") - F.col("_sig"), "close", live),
                   rsi_momentum=s.diff("rsi_14", 20))


def support_resistance(s: Pieces, n, live: bool = False) -> Pieces:
    m = _most(5, _part(n, 10))
    k20, k50 = _least(20, m * 2), _least(50, m * 4)
    s.stage(high_20d=s.max("high", k20), low_20d=s.min("low", k20), high_50d=s.max("high", k50), low_50d=s.min("low", k50))
    s.stage(_ph=s.lag("high_20d"), _pl=s.lag("low_20d"))
    c = F.col("close")
    place = lambda w: guarded(c - F.col(f"low_{w}"), F.col(f"high_{w}") - F.col(f"low_{w}"))
    return s.stage(
        range_position_20d=place("20d"), range_position_50d=place("50d"),
        dist_to_high_20d=div(F.col("high_20d") - c, c, live), dist_to_low_20d=div(c - F.col("low_20d"), c, live),
        breakout_high=flag(c > F.col("_ph")), breakdown_low=flag(c < F.col("_pl")),
    )


def accumulation(s: Pieces) -> Pieces:
    """Money-flow volume and its running line.  Running values come first in a build: their summary
    pass then reads raw bars only."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    s.stage(_mf=guarded((c - lo) - (h - c), h - lo) * F.col("volume"))
    return s.expanding(ad_line=("sum", F.col("_mf")))


def volume(s: Pieces, n) -> Pieces:
    m = _most(5, _part(n, 10))
    k10, k20 = _least(10, m), _least(20, m * 2)
    return s.stage(volume_ratio=guarded("_v10", "_v50"), volume_trend=s.pct("_v10", k10), ad_slope=s.pct("ad_line", k20),
                   cmf=guarded(s.sum("_mf", k20), s.sum("volume", k20)))


#: Columns and defaults when a derivative input is absent.
ABSENT = {
    "funding_rate": {n: 0.0 for n in ("funding_cumsum_7d", "funding_cumsum_30d", "funding_ma_7d", "funding_ma_30d",
                                      "funding_trend", "funding_zscore_swing", "funding_extreme_long", "funding_extreme_short")},
    "sum_open_interest": {n: 0.0 for n in ("oi_ma_7d", "oi_ma_30d", "oi_trend_swing", "oi_change_7d", "oi_change_30d",
                                           "oi_price_div_swing", "oi_zscore_swing")},
    "long_short_ratio": {"ls_ma_7d": 1.0, "ls_ma_30d": 1.0, "ls_trend_swing": 0.0, "ls_zscore_swing": 0.0,
                         "crowd_extreme_long": 0.0, "crowd_extreme_short": 0.0},
    "buy_sell_ratio": {"taker_ma_7d": 1.0, "taker_ma_30d": 1.0, "taker_trend_swing": 0.0, "taker_cumsum_7d": 0.0},
    "lastFundingRate": {"premium_ma_7d": 0.0, "premium_ma_30d": 0.0, "premium_trend_swing": 0.0,
                        "basis_persistent_pos": 0.5, "basis_persistent_neg": 0.5},
}


def sources(s: Pieces) -> Pieces:
    """Derivative inputs with their defaults, before any window looks at them."""
    given = {"funding_rate": ("_fr", 0.0), "long_short_ratio": ("_ls", 1.0), "buy_sell_ratio": ("_bs", 1.0), "lastFundingRate": ("_pr0", 0.0)}
    s.stage(**{name: F.coalesce(source, F.lit(default)) for source, (name, default) in given.items() if s.has(source)})
    if s.has("buy_sell_ratio"):
        s.stage(_bs1=F.col("_bs") - 1)
    if s.has("lastFundingRate"):
        s.stage(_pos=(F.col("_pr0") > 0).cast("double"), _neg=(F.col("_pr0") < 0).cast("double"))
    return s.expanding(_oi=("last", F.col("sum_open_interest"))) if s.has("sum_open_interest") else s


def derivatives(s: Pieces, n) -> Pieces:
    m = _most(5, _part(n, 10))
    week, month, quarter = _least(7, m), _least(30, m * 3), _least(90, m * 4)
    for source, defaults in ABSENT.items():
        if not s.has(source):
            s.stage(**{k: F.lit(v) for k, v in defaults.items()})
    if s.has("funding_rate"):
        s.stage(funding_cumsum_7d=s.sum("_fr", _least(21, m * 3)), funding_cumsum_30d=s.sum("_fr", _least(90, m * 6)),
                funding_ma_7d=s.mean("_fr", _least(21, m * 2)), funding_ma_30d=s.mean("_fr", quarter), _fsd=s.std("_fr", quarter))
        s.stage(funding_trend=F.col("funding_ma_7d") - F.col("funding_ma_30d"),
                funding_zscore_swing=guarded(F.col("_fr") - F.col("funding_ma_30d"), "_fsd"))
        s.stage(funding_extreme_long=flag(F.col("funding_zscore_swing") > 2),
                funding_extreme_short=flag(F.col("funding_zscore_swing") < -2))
    if s.has("sum_open_interest"):
        s.stage(oi_ma_7d=s.mean("_oi", week), oi_ma_30d=s.mean("_oi", month), oi_change_7d=s.pct("_oi", week),
                oi_change_30d=s.pct("_oi", month), _pc30=s.pct("close", month), _om=s.mean("_oi", quarter), _os=s.std("_oi", quarter))
        s.stage(oi_trend_swing=guarded("oi_ma_7d", "oi_ma_30d") - 1, oi_price_div_swing=F.col("oi_change_30d") - F.col("_pc30"),
                oi_zscore_swing=guarded(F.col("_oi") - F.col("_om"), "_os"))
    if s.has("long_short_ratio"):
        s.stage(ls_ma_7d=s.mean("_ls", week), ls_ma_30d=s.mean("_ls", month), _lm=s.mean("_ls", quarter), _lsd=s.std("_ls", quarter))
        s.stage(ls_trend_swing=guarded("ls_ma_7d", "ls_ma_30d") - 1, ls_zscore_swing=guarded(F.col("_ls") - F.col("_lm"), "_lsd"))
        s.stage(crowd_extreme_long=flag(F.col("ls_zscore_swing") > 1.5), crowd_extreme_short=flag(F.col("ls_zscore_swing") < -1.5))
    if s.has("buy_sell_ratio"):
        s.stage(taker_ma_7d=s.mean("_bs", week), taker_ma_30d=s.mean("_bs", month), taker_cumsum_7d=s.sum("_bs1", week))
        s.stage(taker_trend_swing=F.col("taker_ma_7d") - F.col("taker_ma_30d"))
    if s.has("lastFundingRate"):
        s.stage(premium_ma_7d=s.mean("_pr0", week), premium_ma_30d=s.mean("_pr0", month),
                basis_persistent_pos=s.mean("_pos", week), basis_persistent_neg=s.mean("_neg", week))
        s.stage(premium_trend_swing=F.col("premium_ma_7d") - F.col("premium_ma_30d"))
    return s


def _parts(s: Pieces, n, live: bool) -> Pieces:
    moving_averages(s, n, live)
    regime(s, n, live)
    macro_volatility(s, n, live)
    if live:
        zeros(s, "dominance_change_5d", "dominance_change_20d", "dominance_vs_sma", "dominance_rising", "dominance_falling")
    else:
        dominance(s)
    momentum(s, live)
    support_resistance(s, n, live)
    volume(s, n)
    return zeros(s, *LIVE_ZERO) if live else derivatives(s, n)


#: Futures-only inputs that a live spot feed reports as zero.
LIVE_ZERO = [
    "taker_buy_volume", "taker_buy_quote_volume", "mark_close", "basis", "premium_close", "funding_cumsum_7d",
    "funding_cumsum_30d", "funding_trend", "funding_zscore_swing", "funding_extreme_long", "funding_extreme_short",
    "oi_trend_swing", "oi_change_7d", "oi_change_30d", "oi_price_div_swing", "oi_zscore_swing", "ls_trend_swing",
    "ls_zscore_swing", "crowd_extreme_long", "crowd_extreme_short", "taker_trend_swing", "taker_cumsum_7d",
    "premium_trend_swing", "basis_persistent_pos", "basis_persistent_neg",
]

#: Core feature order of the live long-horizon vector.
LIVE_FEATURES = [
    "price_vs_sma20", "price_vs_sma50", "price_vs_sma100", "price_vs_sma200", "ma_cross_20_50", "ma_cross_50_100",
    "ma_cross_50_200", "ma_cross_100_200", "golden_cross", "death_cross", "sma50_slope", "sma200_slope", "ma_spread",
    "return_20d", "return_50d", "regime_bull", "regime_bear", "regime_flat", "regime_duration_norm", "volatility_20",
    "volatility_50", "volatility_100", "volatility_annual", "vol_regime", "high_vol_flag", "low_vol_flag", "atr_14",
    "atr_50", "atr_norm", "atr_ratio", "bb_width", "drawdown", "rsi_14", "rsi_7", "macd_norm", "macd_signal", "roc_10",
    "roc_20", "roc_50", "price_momentum", "rsi_momentum", "range_position_20d", "range_position_50d",
    "dist_to_high_20d", "dist_to_low_20d", "breakout_high", "breakdown_low", "volume_ratio", "volume_trend", "ad_slope", "cmf",
]


def swing_features(bars: DataFrame, live: bool = False, rows: int | None = None) -> DataFrame:
    """Needs the series length per row as column ``n``."""
    n = F.col("n").cast("int")
    s = accumulation(begin(bars, rows=rows))
    if not live:
        sources(s)
    build = lambda: _parts(s, n, live)
    s.foresee(lambda: (levels(s, n, live), build()))  # windows over the bars themselves
    levels(s, n, live)
    s.foresee(build)  # and over what was just added
    return build().close()
