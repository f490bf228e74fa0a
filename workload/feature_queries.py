"""Feature builders over gap-filled bars: F1-F48 and the window primitives beneath them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.operators import bars as B
from marketspark.operators import asof
from marketspark.operators.features import build, clean, intraday, labels, risk, scalp, swing, technical
from marketspark.functions.series import Pieces
from workload.registry import EVENT_TICKS, HOURLY, bars_sql, event_ticks, hourly, query, table
from workload.sqltext import (BASE, W, corr, cummax, cumsum, diff, ewm, flag, grd, hits, kurt, lag, lead, mean, mn, mx, over, pct, quant, ratio,
                               rsi_raw, rsum, skew, slope, staged, std, std0, zscore)


def out(df, names, digits=None, keys=("symbol", "ts")):
    """Keys and rounded doubles, in the form the comparison SQL gives."""
    digits = digits or {}
    return df.select(*keys, *[F.round(F.col(n).cast("double"), digits.get(n, 6)).alias(n) for n in names])


def ema_diff(a, b, live):
    return f"({a} - {b}) / nullif({b}{' + 1e-10' if live else ''}, 0)"


# ------------------------------------------------------------------ scalp


def scalp_stages(live: bool):
    e = "+ 1e-10" if live else ""
    return BASE + [
        {**{f"log_return_{k}": f"ln({ratio('close', lag('close', k))})" for k in (1, 3, 5, 10)},
         "cum_return_5": rsum("lr", 5), "cum_return_10": rsum("lr", 10),
         **{f"rsi_{k}": f"(({rsi_raw(k, live)}) - 50) / 50" for k in (5, 7, 14)},
         **{f"micro_vol_{k}": std("lr", k) for k in (3, 5, 10)}, **{f"atr_{k}": mean("tr", k) for k in (5, 10)},
         **{f"v{k}": mean("volume", k) for k in (5, 10, 20)}, "volume_momentum": pct("volume", 3),
         **{f"e{k}": ewm("close", k, not live) for k in (3, 8, 13)}, "lo5": mn("low", 5), "hi5": mx("high", 5),
         "roc_3": pct("close", 3), "roc_5": pct("close", 5),
         "ph": f"CASE WHEN pos >= 5 THEN max(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END",
         "pl": f"CASE WHEN pos >= 5 THEN min(low) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END"},
        {"rsi_slope": diff("rsi_14", 3), "vol_ratio_3_10": grd("micro_vol_3", "micro_vol_10"), "atr_norm_5": "atr_5 / close", "atr_norm_10": "atr_10 / close",
         "atr_expansion": grd("atr_5", "atr_10"), **{f"volume_ratio_{k}": grd("volume", f"v{k}") for k in (5, 10, 20)}, "volume_trend": f"{grd('v5', 'v20')} - 1",
         "bar_position": grd("close - low", "high - low"), "bar_range_pct": "(high - low) / close", "bar_body_pct": "abs(close - open) / close",
         "upper_shadow": grd("high - greatest(open, close)", "high - low"), "lower_shadow": grd("least(open, close) - low", "high - low"),
         "gap": f"(open - prev) / nullif(prev {e}, 0)", "high_break": flag("high > ph"), "low_break": flag("low < pl"),
         "ema_cross_3_8": ema_diff("e3", "e8", live), "ema_cross_3_13": ema_diff("e3", "e13", live), "ema_cross_8_13": ema_diff("e8", "e13", live),
         "price_vs_ema3": ema_diff("close", "e3", live), "price_vs_ema8": ema_diff("close", "e8", live), "stoch_k_5": f"{grd('close - lo5', 'hi5 - lo5')} - 0.5"},
        {"volume_spike": flag("volume_ratio_10 > 2"), "stoch_d_5": mean("stoch_k_5", 3)},
    ]


@query("scalp_features", staged(HOURLY, scalp_stages(False), scalp.LIVE_FEATURES))
def scalp_batch(spark, sf):
    return out(scalp.scalp_features(hourly(spark, sf)), scalp.LIVE_FEATURES)


@query("scalp_features_live", staged(HOURLY, scalp_stages(True), scalp.LIVE_FEATURES))
def scalp_live(spark, sf):
    return out(scalp.scalp_features(hourly(spark, sf), live=True), scalp.LIVE_FEATURES)


#: Derivative-like inputs derived from the bars: enough to exercise every optional branch.
SIDE = {
    "funding_rate": "(buy_volume - sell_volume) / (volume + 1) / 500.0", "sum_open_interest": "1000 + close * 3 + volume", "open_interest": "1000 + close * 3 + volume",
    "long_short_ratio": "(buy_volume + 1) / (sell_volume + 1)", "long_account": "(buy_volume + 1) / (volume + 2)", "short_account": "(sell_volume + 1) / (volume + 2)",
    "buy_sell_ratio": "(buy_volume + 2) / (sell_volume + 2)", "buy_vol": "buy_volume + 1", "sell_vol": "sell_volume + 1",
    "premium_close": "(high - close) / (high + 1)", "basis": "(close - low) / (low + 1)", "lastFundingRate": "(close - open) / 99991.0", "taker_buy_base": "buy_volume",
}
SIDE_SQL = HOURLY + ", side AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in SIDE.items()) + " FROM bars)"


def side_bars(spark, sf, *names):
    b = hourly(spark, sf)
    return b.withColumns({n: F.expr(SIDE[n]) for n in (names or SIDE)})


DERIV = ["buy_pressure", "buy_pressure_sma", "imbalance_momentum", "cum_imbalance_5", "cum_imbalance_10", "funding_rate_norm", "funding_rate_sma", "funding_rate_change",
         "funding_rate_zscore", "oi_change", "oi_zscore", "oi_change_sma", "oi_price_divergence", "ls_ratio_norm", "ls_ratio_change", "ls_ratio_zscore", "ls_ratio_sma", "long_pct",
         "short_pct", "long_short_diff", "taker_buy_sell_ratio", "taker_buy_sell_diff", "taker_vol_total", "taker_vol_change", "premium_norm", "premium_zscore", "premium_sma",
         "basis_sma", "basis_zscore"]
DERIV_STAGES = BASE + [
    {"buy_pressure": f"{grd('taker_buy_base', 'volume')} - 0.5", "funding_rate_norm": "funding_rate * 1000", "funding_rate_sma": f"({mean('funding_rate', 8)}) * 1000",
     "funding_rate_change": f"{diff('funding_rate')} * 1000", "funding_rate_zscore": zscore("funding_rate", 24), "oi_change": pct("sum_open_interest"),
     "oi_zscore": zscore("sum_open_interest", 24), "ls_ratio_norm": "long_short_ratio - 1", "ls_ratio_change": pct("long_short_ratio"), "ls_ratio_zscore": zscore("long_short_ratio", 24),
     "long_pct": "long_account", "short_pct": "short_account", "long_short_diff": "long_account - short_account", "taker_buy_sell_ratio": grd("buy_vol", "sell_vol"),
     "taker_buy_sell_diff": grd("buy_vol - sell_vol", "buy_vol + sell_vol"), "taker_vol_total": "buy_vol + sell_vol", "premium_norm": "premium_close * 100",
     "premium_zscore": zscore("premium_close", 24), "basis_sma": mean("basis", 8), "basis_zscore": zscore("basis", 24)},
    {"buy_pressure_sma": mean("buy_pressure", 5), "imbalance_momentum": diff("buy_pressure", 3), "cum_imbalance_5": rsum("buy_pressure", 5), "cum_imbalance_10": rsum("buy_pressure", 10),
     "oi_change_sma": mean("oi_change", 5), "oi_price_divergence": "oi_change - ret", "ls_ratio_sma": mean("ls_ratio_norm", 5), "taker_vol_change": pct("taker_vol_total"),
     "premium_sma": mean("premium_norm", 8)},
]


@query("scalp_derivatives", staged(SIDE_SQL, DERIV_STAGES, DERIV, source="side"))
def scalp_derivatives(spark, sf):
    return out(scalp.scalp_features(side_bars(spark, sf)), DERIV)


# ------------------------------------------------------------------ intraday

INTRA = ["sma_10", "sma_20", "sma_50", "price_vs_sma10", "price_vs_sma20", "price_vs_sma50", "sma_cross_10_20", "sma_cross_10_50", "sma_cross_20_50", "trend_slope_10", "trend_slope_20",
         "ema_trend", "ema_trend_slope", "vwap_10", "vwap_20", "vwap_dev_10", "vwap_dev_20", "vwap_upper", "vwap_lower", "vwap_position", "volatility_10", "volatility_20", "volatility_50",
         "vol_ratio_10_50", "atr_14", "atr_norm", "bb_upper", "bb_lower", "bb_width", "bb_position", "rsi_14", "macd_norm", "macd_signal", "macd_hist_slope", "adx", "di_diff", "volume_ratio",
         "volume_trend", "obv_slope", "mfi"]
BIN10 = (1, 10, 45, 120, 210, 252, 210, 120, 45, 10, 1)
#: Values near a vanishing denominator are compared to fewer digits.
INTRA_DIGITS = {"obv_slope": 4}


def nth(x, weights):
    return " + ".join(f"({(-1) ** i * w}) * " + (x if i == 0 else lag(x, i)) for i, w in enumerate(weights))


def head0(expr, k):
    return f"CASE WHEN pos < {k} THEN 0 ELSE {expr} END"


def intraday_stages(form: str):
    e = "" if form == "batch" else " + 1e-10"
    seeded = form != "batch"
    sd = std0 if form == "fast" else std
    q = lambda a, b: f"(({a}) / nullif(({b}){e}, 0))"
    fast = form == "fast"
    s = BASE + [
        {"r": "coalesce(ret, 0)" if fast else "ret", "tpv": "tp * volume", "ptp": lag("tp"), "updiff": diff("high"), "dndiff": f"-{diff('low')}", "step": "sign(delta) * volume",
         "g0": "coalesce(gain, 0)", "l0": "coalesce(loss, 0)"},
        {**{f"sma_{k}": mean("close", k) for k in (10, 20, 50)}, "e12": ewm("close", 12, not seeded), "e26": ewm("close", 26, not seeded), **{f"sl{k}": slope("close", k) for k in (10, 20)},
         **{f"vwap_{k}": (grd if form == "live" else ratio)(rsum("tpv", k), rsum("volume", k)) for k in (10, 20)}, "sd20": sd("close", 20),
         **{f"volatility_{k}": sd("r", k) for k in (10, 20, 50)}, "atr_14": ewm("tr", 14, False) if fast else mean("tr", 14), "a14": mean("tr", 14),
         "pdm": "CASE WHEN updiff > dndiff AND updiff > 0 THEN updiff ELSE 0 END", "mdm": "CASE WHEN dndiff > updiff AND dndiff > 0 THEN dndiff ELSE 0 END",
         "v10": mean("volume", 10), "v20": mean("volume", 20), "obv": cumsum("coalesce(step, 0)") if fast else f"CASE WHEN step IS NOT NULL THEN {cumsum('step')} END",
         "pf": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "nf": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END",
         "gs": mean("g0", 14), "ls": mean("l0", 14)},
        {"vmid": "sma_20" if form == "live" else "vwap_20", "ema_trend": q("e12 - e26", "e26"), "macd": "e12 - e26", "p14": mean("pdm", 14), "n14": mean("mdm", 14),
         **{f"gl{x}": f"CASE WHEN pos = 13 THEN {x}s WHEN pos > 13 THEN {x}0 END" for x in "gl"}},
        {**{f"price_vs_sma{k}": q(f"close - sma_{k}", f"sma_{k}") for k in (10, 20, 50)}, **{f"sma_cross_{a}_{b}": f"{q(f'sma_{a}', f'sma_{b}')} - 1" for a, b in ((10, 20), (10, 50), (20, 50))},
         **{f"trend_slope_{k}": head0(f"{lag(f'sl{k}')} / close", k) if form == "batch" else head0(f"sl{k} / close", k - 1) if fast else f"sl{k} / close" for k in (10, 20)},
         "ema_trend_slope": head0(nth("ema_trend", (1, 5, 10, 10, 5, 1)), 5) if fast else diff("ema_trend", 5), "vwap_upper": "vmid + 2 * sd20", "vwap_lower": "vmid - 2 * sd20",
         **{f"vwap_dev_{k}": q(f"close - vwap_{k}", f"vwap_{k}") for k in (10, 20)}, "vol_ratio_10_50": grd("volatility_10", "volatility_50"), "atr_norm": q("atr_14", "close") if fast else "atr_14 / close",
         "bb_upper": "sma_20 + 2 * sd20", "bb_lower": "sma_20 - 2 * sd20", "sig": ewm("macd", 9, not seeded), "pdi": f"100 * {q('p14', 'a14')}", "mdi": f"100 * {q('n14', 'a14')}",
         "volume_ratio": grd("volume", "v20"), "volume_trend": f"{grd('v10', 'v20')} - 1",
         "obv_slope": grd(" + ".join(f"({(-1) ** i * w}) * coalesce({'obv' if i == 0 else lag('obv', i)}, 0)" for i, w in enumerate(BIN10)), mean("obv", 10)) if fast
         else grd(diff("obv", 10), f"abs({mean('obv', 10)})" if form == "live" else mean("obv", 10)),
         "mfi": f"(100 - 100 / (1 + {grd(rsum('pf', 14), rsum('nf', 14))})) / 100 - 0.5",
         # Wilder averages: the seed at bar 13, then (13 * previous + change) / 14
         **{f"w{x}": f"CASE WHEN pos >= 13 THEN list_reduce(list(gl{x}) FILTER (WHERE gl{x} IS NOT NULL) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda a, b: (a * 13 + b) / 14) END" for x in "gl"}},
        {"vwap_position": grd("close - vwap_lower", "vwap_upper - vwap_lower"), "bb_width": q("bb_upper - bb_lower", "sma_20"), "bb_position": grd("close - bb_lower", "bb_upper - bb_lower"),
         "macd_norm": q("macd", "close"), "macd_signal": q("macd - sig", "close"), "dx": f"100 * {grd('abs(pdi - mdi)', 'pdi + mdi')}", "di_diff": "(pdi - mdi) / 100",
         "rsi_14": "(CASE WHEN wl = 0 THEN 100 ELSE 100 - 100 / (1 + wg / nullif(wl, 0)) END) / 100 - 0.5 * (CASE WHEN wl IS NULL THEN NULL ELSE 1 END)" if fast else f"({rsi_raw(14, form == 'live')}) / 100 - 0.5"},
        {"macd_hist_slope": head0(nth("macd_signal", (1, 3, 3, 1)), 3) if fast else diff("macd_signal", 3), "adx": f"({mean('dx', 14)}) / 100"},
    ]
    return s


for _form in ("batch", "live", "fast"):
    def _run(spark, sf, form=_form):
        return out(intraday.intraday_features(hourly(spark, sf), form=form), INTRA, INTRA_DIGITS)

    query(f"intraday_features_{_form}", staged(HOURLY, intraday_stages(_form), INTRA, digits=INTRA_DIGITS))(_run)

INTRA_SIDE = ["funding_change", "funding_change_3", "funding_sma", "funding_vs_sma", "funding_extreme_pos", "funding_extreme_neg", "funding_zscore", "oi_change", "oi_change_3", "oi_change_10",
              "oi_vs_sma", "oi_zscore", "oi_momentum", "price_oi_corr", "ls_ratio_norm", "ls_ratio_sma", "ls_ratio_change", "ls_ratio_zscore", "long_short_diff", "taker_ratio_norm",
              "taker_ratio_sma", "taker_imbalance", "taker_vol_change", "premium_norm", "premium_sma", "premium_zscore", "basis_sma", "basis_zscore", "vwap"]
INTRA_SIDE_STAGES = BASE + [
    {"fm8": mean("funding_rate", 8), "tv": "buy_vol + sell_vol", "oi_change": pct("sum_open_interest"), "ls_ratio_norm": "long_short_ratio - 1", "taker_ratio_norm": "buy_sell_ratio - 1",
     "premium_norm": "premium_close * 100", "cv": cumsum("volume"), "ctp": cumsum("tp * volume")},
    {"funding_change": f"{diff('funding_rate')} * 1000", "funding_change_3": f"{diff('funding_rate', 3)} * 1000", "funding_sma": "fm8 * 1000", "funding_vs_sma": "(funding_rate - fm8) * 1000",
     "funding_extreme_pos": flag("funding_rate > 0.001"), "funding_extreme_neg": flag("funding_rate < -0.001"), "funding_zscore": zscore("funding_rate", 24),
     "oi_change_3": pct("sum_open_interest", 3), "oi_change_10": pct("sum_open_interest", 10), "oi_vs_sma": f"{grd('sum_open_interest', mean('sum_open_interest', 10))} - 1",
     "oi_zscore": zscore("sum_open_interest", 24), "oi_momentum": diff("oi_change"), "price_oi_corr": corr("ret", "oi_change", 10), "ls_ratio_sma": mean("ls_ratio_norm", 8),
     "ls_ratio_change": pct("long_short_ratio"), "ls_ratio_zscore": zscore("long_short_ratio", 24), "long_short_diff": "long_account - short_account", "taker_ratio_sma": mean("taker_ratio_norm", 8),
     "taker_imbalance": grd("buy_vol - sell_vol", "tv"), "taker_vol_change": pct("tv"), "premium_sma": mean("premium_norm", 8), "premium_zscore": zscore("premium_close", 24),
     "basis_sma": mean("basis", 8), "basis_zscore": zscore("basis", 24), "vwap": ratio("ctp", "cv")},
]


@query("intraday_derivatives", staged(SIDE_SQL, INTRA_SIDE_STAGES, INTRA_SIDE, source="side"))
def intraday_derivatives(spark, sf):
    return out(intraday.intraday_features(side_bars(spark, sf)), INTRA_SIDE)


# ------------------------------------------------------------------ swing

SWING = ["price_vs_sma20", "price_vs_sma50", "price_vs_sma100", "price_vs_sma200", "ma_cross_20_50", "ma_cross_50_100", "ma_cross_50_200", "ma_cross_100_200", "golden_cross", "death_cross",
         "sma50_slope", "sma200_slope", "ma_spread", "return_20d", "return_50d", "regime_bull", "regime_bear", "regime_flat", "regime_duration", "regime_duration_norm", "volatility_20",
         "volatility_50", "volatility_100", "volatility_annual", "vol_regime", "high_vol_flag", "low_vol_flag", "atr_14", "atr_50", "atr_norm", "atr_ratio", "bb_width", "drawdown", "rsi_14",
         "rsi_7", "macd_norm", "macd_signal", "roc_10", "roc_20", "roc_50", "price_momentum", "rsi_momentum", "high_20d", "low_20d", "high_50d", "low_50d", "range_position_20d",
         "range_position_50d", "dist_to_high_20d", "dist_to_low_20d", "breakout_high", "breakdown_low", "volume_ratio", "volume_trend", "ad_line", "ad_slope", "cmf"]
SWING_DIGITS = {"ad_line": 4, "ad_slope": 4}


def dyn(fn, x, k):
    """Aggregate over the last k rows, k an expression; null unless k values are there."""
    rows = f"list_slice(list({x}) {over(200)}, -CAST({k} AS BIGINT), -1)"
    return f"CASE WHEN pos + 1 >= {k} AND list_aggregate({rows}, 'count') = {k} THEN list_aggregate({rows}, '{fn}') END"


def swing_stages(live: bool, adaptive: bool):
    """Constant windows of a long series, or per-row lengths from n for a short one."""
    e = " + 1e-10" if live else ""
    q = lambda a, b: f"(({a}) / nullif(({b}){e}, 0))"
    if adaptive:
        agg = {"avg": lambda x, k: dyn("avg", x, k), "max": lambda x, k: dyn("max", x, k), "min": lambda x, k: dyn("min", x, k), "sum": lambda x, k: dyn("sum", x, k),
               "std": lambda x, k: dyn("stddev_samp", x, k), "med": lambda x, k: dyn("median", x, k)}
        least = lambda a, b: f"least({a}, {b})"
        lg = lambda x, k: f"lag({x}, CAST({k} AS INTEGER)) OVER ({W})"
        m3, m5, m10, n3, n5 = "least(20, n // 3)", "greatest(10, n // 5)", "greatest(5, n // 10)", "(n // 3)", "(n // 5)"
    else:
        agg = {"avg": mean, "max": mx, "min": mn, "sum": rsum, "std": std, "med": lambda x, k: quant(x, 0.5, k)}
        least = lambda a, b: min(a, eval(str(b)))
        lg = lag
        m3, m5, m10, n3, n5 = "20", "60", "30", "100", "60"
    t = lambda m, k: f"{m} * {k}"
    if live:
        wid = {w: least(w, t(m5, w // 20 + 1)) for w in (20, 50, 100, 200)}
        vol = {20: least(20, m10), 50: least(50, t(m10, 2)), 100: least(100, t(m10, 5))}
        k_med, k14, k50, k_dd = least(100, t(m10, 8)), least(14, m10), least(50, t(m10, 4)), least(50, t(m10, 4))
    else:
        wid = {20: least(20, m3), 50: least(50, t(m3, 2)), 100: least(100, t(m3, 4)), 200: least(200, t(m3, 6))}
        vol = {20: least(20, t(m10, 2)), 50: least(50, t(m10, 4)), 100: least(100, t(m10, 8))}
        k_med, k14, k50, k_dd = least(100, n3), least(14, n5), least(50, n3), least(50, n3)
    k10, k20, kk50 = least(10, m10), least(20, t(m10, 2)), least(50, t(m10, 4))
    pl = lambda x, k: f"({x} / nullif({lg(x, k)}, 0) - 1)"
    reg = ({"ra50": agg["avg"]("close", least(50, t(m10, 4))), "ra200": agg["avg"]("close", least(200, t(m10, 8))), "return_20d": pl("close", least(20, t(m10, 2))), "return_50d": pl("close", least(50, t(m10, 4)))}
           if live else {"return_20d": pct("close", 20), "return_50d": pct("close", 50)})
    return BASE + [
        {**{f"sma_{w}": agg["avg"]("close", k) for w, k in wid.items()}, **reg, **{f"volatility_{w}": agg["std"]("ret", k) for w, k in vol.items()}, "atr_14": agg["avg"]("tr", k14),
         "atr_50": agg["avg"]("tr", k50), "peak": agg["max"]("close", k_dd), "mid": mean("close", 20), "sd": std("close", 20), "e12": ewm("close", 12, not live), "e26": ewm("close", 26, not live),
         "high_20d": agg["max"]("high", k20), "low_20d": agg["min"]("low", k20), "high_50d": agg["max"]("high", kk50), "low_50d": agg["min"]("low", kk50), "v10": agg["avg"]("volume", k10),
         "v50": agg["avg"]("volume", kk50), "mf": f"{grd('(close - low) - (high - close)', 'high - low')} * volume", "rsi_14": f"({rsi_raw(14, live)}) / 100 - 0.5",
         "rsi_7": f"({rsi_raw(7, live)}) / 100 - 0.5", **{f"roc_{k}": pct("close", k) for k in (10, 20, 50)}, "price_momentum": pct("close", 20)},
        {**({} if live else {"ra50": "sma_50", "ra200": "sma_200"}), "med": agg["med"]("volatility_50", k_med), "macd": "e12 - e26", "ad_line": cumsum("mf"), "q50": lag("sma_50"), "q200": lag("sma_200"),
         "q20h": lag("high_20d"), "q20l": lag("low_20d")},
        {**{f"price_vs_sma{w}": q(f"close - sma_{w}", f"sma_{w}") for w in (20, 50, 100, 200)}, **{f"ma_cross_{a}_{b}": f"{q(f'sma_{a}', f'sma_{b}')} - 1" for a, b in ((20, 50), (50, 100), (50, 200), (100, 200))},
         "golden_cross": flag("sma_50 > sma_200 AND q50 <= q200"), "death_cross": flag("sma_50 < sma_200 AND q50 >= q200"), "sma50_slope": pct("sma_50", 5), "sma200_slope": pct("sma_200", 10),
         "ma_spread": q("sma_50 - sma_200", "sma_200"), "regime": "CASE WHEN close > ra50 AND ra50 > ra200 AND return_20d > 0.02 THEN 1 WHEN close < ra50 AND ra50 < ra200 AND return_20d < -0.02 THEN -1 ELSE 0 END",
         "volatility_annual": "volatility_20 * sqrt(365)", "vol_regime": grd("volatility_20", "med"), "atr_norm": q("atr_14", "close"), "atr_ratio": grd("atr_14", "atr_50"), "bb_width": q("4 * sd", "mid"),
         "drawdown": q("close - peak", "peak"), "sig": ewm("macd", 9, not live), "rsi_momentum": diff("rsi_14", 20), **{f"range_position_{w}": grd(f"close - low_{w}", f"high_{w} - low_{w}") for w in ("20d", "50d")},
         "dist_to_high_20d": q("high_20d - close", "close"), "dist_to_low_20d": q("close - low_20d", "close"), "breakout_high": flag("close > q20h"), "breakdown_low": flag("close < q20l"),
         "volume_ratio": grd("v10", "v50"), "volume_trend": pl("v10", k10), "ad_slope": pl("ad_line", k20), "cmf": grd(agg["sum"]("mf", k20), agg["sum"]("volume", k20))},
        {"regime_bull": flag("regime = 1"), "regime_bear": flag("regime = -1"), "regime_flat": flag("regime = 0"), "high_vol_flag": flag("vol_regime > 1.5"), "low_vol_flag": flag("vol_regime < 0.7"),
         "macd_norm": q("macd", "close"), "macd_signal": q("macd - sig", "close"), "change": f"CASE WHEN {lag('regime')} IS NULL OR regime <> {lag('regime')} THEN pos END"},
        {"regime_duration": f"pos - {cummax('change')} + 1"},
        {"regime_duration_norm": "regime_duration / 50.0"},
    ]


FOUR_HOURLY = bars_sql(EVENT_TICKS, 14_400)


def four_hourly(spark, sf):
    return B.resample(event_ticks(spark, sf), "4h")


@query("swing_features", staged(HOURLY, swing_stages(False, False), SWING, digits=SWING_DIGITS))
def swing_long(spark, sf):
    return out(swing.swing_features(hourly(spark, sf)), SWING, SWING_DIGITS)


@query("swing_features_short_series", staged(FOUR_HOURLY, swing_stages(False, True), SWING, digits=SWING_DIGITS))
def swing_short(spark, sf):
    return out(swing.swing_features(four_hourly(spark, sf)), SWING, SWING_DIGITS)


@query("swing_features_live", staged(HOURLY, swing_stages(True, False), SWING, digits=SWING_DIGITS))
def swing_live(spark, sf):
    return out(swing.swing_features(hourly(spark, sf), live=True), SWING, SWING_DIGITS)


@query("swing_features_live_short", staged(FOUR_HOURLY, swing_stages(True, True), SWING, digits=SWING_DIGITS))
def swing_live_short(spark, sf):
    return out(swing.swing_features(four_hourly(spark, sf), live=True), SWING, SWING_DIGITS)


SWING_SIDE = [n for s in swing.ABSENT.values() for n in s]
SWING_SIDE_STAGES = BASE + [
    {"ls_ma_7d": mean("long_short_ratio", 7), "ls_ma_30d": mean("long_short_ratio", 30), "ls_zscore_swing": zscore("long_short_ratio", 90), "taker_ma_7d": mean("buy_sell_ratio", 7),
     "taker_ma_30d": mean("buy_sell_ratio", 30), "bs1": "buy_sell_ratio - 1", "premium_ma_7d": mean("lastFundingRate", 7), "premium_ma_30d": mean("lastFundingRate", 30),
     "up": "CAST(lastFundingRate > 0 AS DOUBLE)", "dn": "CAST(lastFundingRate < 0 AS DOUBLE)", "oi_ma_7d": mean("sum_open_interest", 7), "oi_ma_30d": mean("sum_open_interest", 30),
     "oi_change_7d": pct("sum_open_interest", 7), "oi_change_30d": pct("sum_open_interest", 30), "pc30": pct("close", 30), "oi_zscore_swing": zscore("sum_open_interest", 90),
     "funding_cumsum_7d": rsum("funding_rate", 21), "funding_cumsum_30d": rsum("funding_rate", 90), "funding_ma_7d": mean("funding_rate", 21), "funding_ma_30d": mean("funding_rate", 90),
     "funding_zscore_swing": zscore("funding_rate", 90)},
    {"ls_trend_swing": f"{grd('ls_ma_7d', 'ls_ma_30d')} - 1", "crowd_extreme_long": flag("ls_zscore_swing > 1.5"), "crowd_extreme_short": flag("ls_zscore_swing < -1.5"),
     "taker_trend_swing": "taker_ma_7d - taker_ma_30d", "taker_cumsum_7d": rsum("bs1", 7), "premium_trend_swing": "premium_ma_7d - premium_ma_30d", "basis_persistent_pos": mean("up", 7),
     "basis_persistent_neg": mean("dn", 7), "oi_trend_swing": f"{grd('oi_ma_7d', 'oi_ma_30d')} - 1", "oi_price_div_swing": "oi_change_30d - pc30", "funding_trend": "funding_ma_7d - funding_ma_30d",
     "funding_extreme_long": flag("funding_zscore_swing > 2"), "funding_extreme_short": flag("funding_zscore_swing < -2")},
]


@query("swing_derivatives", staged(SIDE_SQL, SWING_SIDE_STAGES, SWING_SIDE, source="side"))
def swing_derivatives(spark, sf):
    return out(swing.swing_features(side_bars(spark, sf)), SWING_SIDE)


DOM = ["dominance_change_5d", "dominance_change_20d", "dominance_vs_sma", "dominance_rising", "dominance_falling"]
DOM_SQL = HOURLY + """, dom AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) AS ts, 50 + avg(close) / 100 AS btc_dominance FROM bars GROUP BY 1),
 joined AS (SELECT b.*, last_value(d.btc_dominance IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b.ts) AS btc_dominance FROM bars b LEFT JOIN dom d ON d.ts = b.ts)"""


@query("swing_dominance", staged(DOM_SQL, [
    {"dominance_change_5d": pct("btc_dominance", 5), "dominance_change_20d": pct("btc_dominance", 20), "dominance_vs_sma": f"{ratio('btc_dominance', mean('btc_dominance', 20))} - 1"},
    {"dominance_rising": flag("dominance_change_5d > 0.01"), "dominance_falling": flag("dominance_change_5d < -0.01")}], DOM, source="joined"))
def swing_dominance(spark, sf):
    b = hourly(spark, sf)
    dom = b.groupBy(F.window("ts", "3 hours").start.alias("ts")).agg((50 + F.avg("close") / 100).alias("btc_dominance"))
    return out(swing.swing_features(asof.join_market_series(b, dom)), DOM)


# ------------------------------------------------------------------ risk

COMPACT = [f for f in risk.LIVE_FEATURES if not f.startswith("model_")]


def compact_stages(live: bool):
    e = " + 1e-10" if live else ""
    q = lambda a, b: f"(({a}) / nullif(({b}){e}, 0))"
    return BASE + [
        {**{f"volatility_{k}": std("ret", k) for k in (5, 10, 20, 50)}, "atr_14": mean("tr", 14), "atr_50": mean("tr", 50), "v20": mean("volume", 20), "v50": mean("volume", 50),
         "c20": mean("close", 20), "c50": mean("close", 50), "r20": pct("close", 20), "peak": mx("close", 50), "rs": rsi_raw(14, live), "l1": lag("ret")},
        {"vol_ratio_5_20": grd("volatility_5", "volatility_20"), "vol_ratio_10_50": grd("volatility_10", "volatility_50"), "atr_norm": q("atr_14", "close"), "atr_ratio": grd("atr_14", "atr_50"),
         "volume_ratio": grd("volume", "v20"), "volume_trend": f"{grd('v20', 'v50')} - 1", "trend_strength": q("c20 - c50", "c50"), "price_vs_sma20": q("close - c20", "c20"),
         "price_vs_sma50": q("close - c50", "c50"), "regime_bull": flag("r20 > 0.05"), "regime_bear": flag("r20 < -0.05"), "regime_flat": flag("r20 BETWEEN -0.05 AND 0.05"),
         "drawdown": q("close - peak", "peak"), "bar_range": q("high - low", "close"), "gap": q("abs(open - prev)", "prev"), "rsi_14": "rs / 100 - 0.5" if live else "(rs - 50) / 50",
         "rsi_extreme_high": flag("rs > 80"), "rsi_extreme_low": flag("rs < 20"),
         "return_autocorr": f"CASE WHEN count(ret) {over(20)} = 20 THEN {ratio(f'covar_pop(ret, l1) {over(19)}', f'sqrt(var_pop(ret) {over(19)} * var_pop(l1) {over(19)})')} END"},
        {"low_liquidity": flag("volume_ratio < 0.5"), "gap_risk": flag("gap > 0.01"), "depth": "abs(drawdown)"},
        {"drawdown_depth": mx("depth", 10) if live else "depth"},
    ]


for _live in (False, True):
    def _compact(spark, sf, live=_live):
        return out(risk.compact_features(hourly(spark, sf), live=live), COMPACT)

    query("risk_compact" + ("_live" if _live else ""), staged(HOURLY, compact_stages(_live), COMPACT))(_compact)

PRESSURE = ["funding_zscore", "funding_extreme", "funding_risk", "funding_cumsum_risk", "oi_change_risk", "oi_zscore", "oi_extreme_high", "oi_dropping_fast", "ls_zscore", "crowd_long_risk",
            "crowd_short_risk", "crowded_trade", "taker_imbalance", "aggressive_selling", "aggressive_buying", "basis_risk", "high_premium", "derivatives_risk"]


@query("risk_derivatives_pressure", staged(SIDE_SQL, [
    {"funding_zscore": zscore("funding_rate", 100), "funding_risk": "abs(funding_rate) * 100", "funding_cumsum_risk": f"abs({rsum('funding_rate', 24)})", "oc": pct("sum_open_interest"),
     "oi_zscore": zscore("sum_open_interest", 100), "ls_zscore": zscore("long_short_ratio", 100), "crowd_long_risk": flag("long_short_ratio > 2.5"), "crowd_short_risk": flag("long_short_ratio < 0.67"),
     "taker_imbalance": "abs(buy_sell_ratio - 1)", "aggressive_selling": flag("buy_sell_ratio < 0.8"), "aggressive_buying": flag("buy_sell_ratio > 1.2"), "basis_risk": "abs(lastFundingRate) * 1000",
     "high_premium": flag("abs(lastFundingRate) > 0.001")},
    {"funding_extreme": flag("abs(funding_zscore) > 2"), "oi_change_risk": "CASE WHEN oc IS NOT NULL THEN least(abs(oc), 0.5) END", "oi_extreme_high": flag("oi_zscore > 2"),
     "oi_dropping_fast": flag("oc < -0.05"), "crowded_trade": "greatest(crowd_long_risk, crowd_short_risk)"},
    {"derivatives_risk": "least(greatest(0.2 * (funding_extreme + oi_extreme_high + crowded_trade + least(taker_imbalance, 1) + high_premium), 0), 1)"}], PRESSURE, source="side"))
def risk_pressure(spark, sf):
    return out(risk.compact_features(side_bars(spark, sf)), PRESSURE)


ROOT = "sqrt(252)"
ADV = {
    "volatility": [*(f"volatility_{k}" for k in (5, 10, 20, 50, 100)), "vol_ratio_5_20", "vol_ratio_10_50", "vol_ratio_20_100", "vol_zscore", "vol_regime_high", "vol_regime_low", "vol_change",
                   "vol_momentum", "vol_clustering", "atr_14", "atr_50", "atr_norm", "atr_ratio"],
    "tail": [*(f"{x}_{k}" for x in ("kurtosis", "skewness", "max_dd") for k in (20, 50, 100)), "extreme_positive", "extreme_negative", "extreme_ratio", "var_95_50", "var_99_50", "cvar_95_50"],
    "liquidity": [*(f"volume_ratio_{k}" for k in (5, 10, 20, 50)), "volume_trend", "volume_trend_long", "volume_volatility", "illiquidity", "illiquidity_sma", "spread_proxy", "spread_proxy_sma",
                  "spread_expansion", "low_liquidity", "very_low_liquidity"],
    "regime": [*(f"price_vs_sma_{k}" for k in (20, 50, 100, 200)), "trend_strength", "trend_direction", "regime_bull", "regime_bear", "regime_flat", "near_high", "near_low", "range_position",
               "mean_reversion_potential"],
    "correlation": [*(f"return_autocorr_{k}" for k in (1, 5, 10)), "vol_return_corr", "range_return_corr", "momentum_consistency"],
    "degradation": ["sharpe_20", "sharpe_50", "sharpe_100", "sharpe_degradation", "ir_stability", "regime_break_indicator", "hit_rate_20", "hit_rate_50", "hit_rate_drift"],
    "drawdown": ["drawdown", "drawdown_depth", "dd_duration", "recovery_speed", "underwater", "deep_underwater"],
    "derivatives": ["funding_rate_norm", "funding_rate_sma", "funding_rate_extreme", "funding_rate_zscore", "oi_change", "oi_change_sma", "oi_momentum", "ls_ratio_norm", "ls_ratio_extreme_long",
                    "ls_ratio_extreme_short"],
}


def acorr(k):
    w = over(50 - k)
    den = f"sqrt(var_pop(ret) {w} * var_pop(lag{k}) {w})"
    return f"CASE WHEN count(ret) {over(50)} = 50 THEN {ratio(f'covar_pop(ret, lag{k}) {w}', den)} END"


ADV_STAGES = {
    "volatility": [
        {**{f"volatility_{k}": std("ret", k) for k in (5, 10, 20, 50, 100)}, "atr_14": mean("tr", 14), "atr_50": mean("tr", 50)},
        {"vol_ratio_5_20": grd("volatility_5", "volatility_20"), "vol_ratio_10_50": grd("volatility_10", "volatility_50"), "vol_ratio_20_100": grd("volatility_20", "volatility_100"),
         "vol_zscore": zscore("volatility_20", 100), "vol_change": pct("volatility_5"), "vol_momentum": diff("volatility_5", 5), "vol_clustering": hits("abs(ret) > volatility_20 * 2", 10),
         "atr_norm": "atr_14 / close", "atr_ratio": grd("atr_14", "atr_50")},
        {"vol_regime_high": flag("vol_zscore > 1"), "vol_regime_low": flag("vol_zscore < -1")}],
    "tail": [
        {**{f"kurtosis_{k}": kurt("ret", k) for k in (20, 50, 100)}, **{f"skewness_{k}": skew("ret", k) for k in (20, 50, 100)}, **{f"pk{k}": mx("close", k) for k in (20, 50, 100)},
         "sd50": std("ret", 50), "var_95_50": quant("ret", 0.05, 50), "var_99_50": quant("ret", 0.01, 50), "w50": f"list(ret) {over(50)}"},
        {"extreme_positive": hits("ret > sd50 * 2.5", 20), "extreme_negative": hits("ret < -sd50 * 2.5", 20), "cvar_95_50": "list_aggregate(list_filter(w50, lambda x: x <= var_95_50), 'avg')",
         **{f"d{k}": f"(close - pk{k}) / pk{k}" for k in (20, 50, 100)}},
        {"extreme_ratio": "extreme_negative / (extreme_positive + 1)", **{f"max_dd_{k}": mn(f"d{k}", k) for k in (20, 50, 100)}}],
    "liquidity": [
        {**{f"m{k}": mean("volume", k) for k in (5, 10, 20, 50)}, "vc": pct("volume"), "illiquidity": f"{grd('abs(ret)', 'volume * close')} * 1e9", "spread_proxy": "(high - low) / close"},
        {**{f"volume_ratio_{k}": grd("volume", f"m{k}") for k in (5, 10, 20, 50)}, "volume_trend": f"{grd('m5', 'm20')} - 1", "volume_trend_long": f"{grd('m20', 'm50')} - 1",
         "volume_volatility": std("vc", 20), "illiquidity_sma": mean("illiquidity", 20), "spread_proxy_sma": mean("spread_proxy", 20)},
        {"spread_expansion": grd("spread_proxy", "spread_proxy_sma"), "low_liquidity": flag("volume_ratio_20 < 0.5"), "very_low_liquidity": flag("volume_ratio_20 < 0.25")}],
    "regime": [
        {**{f"m{k}": mean("close", k) for k in (20, 50, 100, 200)}, "r20": pct("close", 20), "h20": mx("high", 20), "l20": mn("low", 20)},
        {**{f"price_vs_sma_{k}": f"(close - m{k}) / m{k}" for k in (20, 50, 100, 200)}, "trend_strength": "(m20 - m50) / m50", "regime_bull": flag("r20 > 0.05"), "regime_bear": flag("r20 < -0.05"),
         "regime_flat": flag("r20 BETWEEN -0.05 AND 0.05"), "near_high": flag("close >= h20 * 0.98"), "near_low": flag("close <= l20 * 1.02"), "range_position": grd("close - l20", "h20 - l20")},
        {"trend_direction": "sign(trend_strength)", "mean_reversion_potential": "abs(price_vs_sma_20)"}],
    "correlation": [
        {**{f"lag{k}": lag("ret", k) for k in (1, 5, 10)}, "vch": pct("volume"), "hl": "(high - low) / close", "m5": pct("close", 5), "m20": pct("close", 20)},
        {**{f"return_autocorr_{k}": acorr(k) for k in (1, 5, 10)}, "vol_return_corr": corr("ret", "vch", 20), "range_return_corr": corr("ret", "hl", 20), "momentum_consistency": flag("sign(m5) = sign(m20)")}],
    "degradation": [
        {**{f"sharpe_{k}": f"{grd(mean('ret', k), std('ret', k))} * {ROOT}" for k in (20, 50, 100)}, "z100": zscore("ret", 100), "hit_rate_20": f"{hits('ret > 0', 20)} / 20", "hit_rate_50": f"{hits('ret > 0', 50)} / 50"},
        {"sharpe_degradation": "sharpe_20 - sharpe_100", "ir_stability": std("sharpe_20", 20), "regime_break_indicator": hits("abs(z100) > 3", 10), "hit_rate_drift": "hit_rate_20 - hit_rate_50"}],
    "drawdown": [
        {"pk": cummax("close")}, {"drawdown": "(close - pk) / pk"}, {"top": cummax("CASE WHEN drawdown >= 0 THEN pos END")},
        {"drawdown_depth": "abs(drawdown)", "dd_duration": "pos - top", "recovery_speed": diff("drawdown"), "underwater": flag("drawdown < -0.05"), "deep_underwater": flag("drawdown < -0.10")}],
    "derivatives": [
        {"funding_rate_norm": "funding_rate * 1000", "funding_rate_sma": f"({mean('funding_rate', 8)}) * 1000", "funding_rate_extreme": flag("abs(funding_rate) > 0.001"),
         "funding_rate_zscore": zscore("funding_rate", 24), "oi_change": pct("open_interest"), "oi_momentum": pct("open_interest", 24), "ls_ratio_norm": "long_short_ratio - 1",
         "ls_ratio_extreme_long": flag("long_short_ratio > 2"), "ls_ratio_extreme_short": flag("long_short_ratio < 0.5")},
        {"oi_change_sma": mean("oi_change", 12)}],
}
#: Bars without volume make illiquidity huge; it is compared on a log scale.
LOGGED = {"illiquidity": "ln(1 + illiquidity)", "illiquidity_sma": "ln(1 + illiquidity_sma)"}

for _part, _names in ADV.items():
    _side = _part == "derivatives"

    def _adv(spark, sf, part=_part, names=_names, side=_side):
        b = side_bars(spark, sf, "funding_rate", "open_interest", "long_short_ratio") if side else hourly(spark, sf)
        df = risk.advanced_features(b, parts=(part,))
        if part == "liquidity":
            df = df.withColumns({n: F.log1p(n) for n in LOGGED})
        return out(df, names)

    _sql = staged(SIDE_SQL if _side else HOURLY, BASE + ADV_STAGES[_part], _names, source="side" if _side else "bars")
    if _part == "liquidity":
        for _n, _e in LOGGED.items():
            _sql = _sql.replace(f"round(CAST({_n} AS DOUBLE)", f"round(CAST({_e} AS DOUBLE)")
    query(f"risk_advanced_{_part}", _sql)(_adv)

LAZY = ["realized_vol_20", "realized_vol_60", "skewness_20", "drawdown", "rolling_var_95"]


@query("risk_lazy_pair", staged(HOURLY, BASE + [
    {"realized_vol_20": f"({std('ret', 20)}) * {ROOT}", "realized_vol_60": f"({std('ret', 60)}) * {ROOT}", "skewness_20": f"({skew('ret', 20)}) * 18 / sqrt(20 * 19)",
     "drawdown": grd(f"{cummax('close')} - close", cummax("close")), "rolling_var_95": quant("ret", 0.05, 60)}], LAZY))
def risk_lazy(spark, sf):
    return out(risk.lazy_features(hourly(spark, sf)), LAZY)


MODEL = ["model_P_up", "model_P_down", "model_uncertainty", "model_signal_strength", "model_confidence", "model_expected_return"]
MODEL_SQL = HOURLY + """, pred AS (SELECT *, (buy_volume + 1) / (volume + 3) AS P_up, (sell_volume + 1) / (volume + 3) AS P_down FROM bars),
 both_ AS (SELECT *, greatest(P_up, P_down) AS confidence, P_up - P_down AS expected_return FROM pred)"""


@query("risk_model_inputs", staged(MODEL_SQL, [
    {"model_P_up": "P_up", "model_P_down": "P_down", "model_uncertainty": "1 - greatest(P_up, P_down)", "model_signal_strength": "P_up - P_down", "model_confidence": "confidence",
     "model_expected_return": "expected_return"}], MODEL, source="both_"))
def risk_model_inputs(spark, sf):
    b = hourly(spark, sf).withColumns({"P_up": F.expr("(buy_volume + 1) / (volume + 3)"), "P_down": F.expr("(sell_volume + 1) / (volume + 3)")})
    b = b.withColumns({"confidence": F.greatest("P_up", "P_down"), "expected_return": F.col("P_up") - F.col("P_down")})
    return out(risk.advanced_features(b, parts=("model",)), MODEL)


# ------------------------------------------------------------------ technical and base sets

PERIODS = technical.PERIODS
MULTS = {"1_5": 1.5, "2_0": 2.0, "2_5": 2.5, "3_0": 3.0}
MACDS = technical.MACD_SETS
TECH_STAGES = BASE + [
    {"stp": "sign(delta) * volume", **{f"sma_{k}": mean("close", k) for k in PERIODS}, **{f"ema_{k}": ewm("close", k, memory=4096) for k in sorted({*PERIODS, 5, 8, 12, 17, 26, 35})},
     **{f"std_{k}": std("close", k) for k in PERIODS}, **{f"return_{k}": pct("close", k) for k in PERIODS}, **{f"log_return_{k}": f"ln({ratio('close', lag('close', k))})" for k in PERIODS},
     **{f"rsi_{k}": rsi_raw(k, True) for k in (5, 7, 9, 14, 21, 28)}, **{f"atr_{k}": mean("(high - low)", k) for k in (5, 10, 14, 20, 30, 50)},
     **{f"hh{k}": mx("high", k) for k in (14, 28)}, **{f"ll{k}": mn("low", k) for k in (14, 28)}, **{f"volume_sma_{k}": mean("volume", k) for k in (5, 10, 20, 50)},
     **{f"volume_std_{k}": std("volume", k) for k in (5, 10, 20, 50)}, **{f"skew_{k}": f"({skew('ret', k)}) * {k - 2} / sqrt({k} * {k - 1})" for k in (10, 20, 50, 100)},
     **{f"close_lag_{k}": lag("close", k) for k in (1, 2, 3, 5, 10)}, **{f"return_lag_{k}": lag("ret", k) for k in (1, 2, 3, 5, 10)}, **{f"volume_lag_{k}": lag("volume", k) for k in (1, 2, 3, 5, 10)},
     **{f"momentum_{k}": diff("close", k) for k in (5, 10, 20, 50)}, **{f"roc_{k}": f"{grd(diff('close', k), lag('close', k))} * 100" for k in (5, 10, 20, 50)}},
    {"obv": f"CASE WHEN stp IS NOT NULL THEN {cumsum('stp')} END", **{f"macd_{f}_{sl}": f"ema_{f} - ema_{sl}" for f, sl, _ in MACDS}},
    {"obv_sma_20": mean("obv", 20), "obv_slope": f"{diff('obv', 5)} / 5", **{f"macd_signal_{f}_{sl}": ewm(f"macd_{f}_{sl}", sg) for f, sl, sg in MACDS},
     **{f"bb_upper_{k}_{m}": f"sma_{k} + {v} * std_{k}" for k in (10, 20, 50) for m, v in MULTS.items()}, **{f"bb_lower_{k}_{m}": f"sma_{k} - {v} * std_{k}" for k in (10, 20, 50) for m, v in MULTS.items()}},
    {**{f"macd_hist_{f}_{sl}": f"macd_{f}_{sl} - macd_signal_{f}_{sl}" for f, sl, _ in MACDS}, **{f"natr_{k}": f"{grd(f'atr_{k}', 'close')} * 100" for k in (5, 10, 14, 20, 30, 50)},
     **{f"williams_r_{k}": f"-100 * {grd(f'hh{k} - close', f'hh{k} - ll{k}')}" for k in (14, 28)}, **{f"volume_ratio_{k}": grd("volume", f"volume_sma_{k}") for k in (5, 10, 20, 50)},
     **{f"bb_width_{k}_{m}": grd(f"bb_upper_{k}_{m} - bb_lower_{k}_{m}", f"sma_{k}") for k in (10, 20, 50) for m in MULTS},
     **{f"bb_pct_{k}_{m}": grd(f"close - bb_lower_{k}_{m}", f"bb_upper_{k}_{m} - bb_lower_{k}_{m}") for k in (10, 20, 50) for m in MULTS},
     **{f"zscore_{k}": grd(f"close - sma_{k}", f"std_{k}") for k in (10, 20, 50, 100)}, **{f"sma_{a}_{b}_cross": f"CAST(sma_{a} > sma_{b} AS INTEGER)" for a, b in ((5, 20), (10, 50), (20, 100))},
     **{f"price_sma_{k}_cross": f"CAST(close > sma_{k} AS INTEGER)" for k in (20, 50)}, "body_size": grd("abs(close - open)", "high - low"), "upper_shadow": grd("high - greatest(close, open)", "high - low"),
     "lower_shadow": grd("least(close, open) - low", "high - low"), "is_bullish": "CAST(close > open AS INTEGER)", "is_doji": f"CAST({grd('abs(close - open)', 'high - low')} < 0.1 AS INTEGER)"},
]
TECH = [n for st in TECH_STAGES[2:] for n in st if n not in ("stp", "ema_8", "ema_12", "ema_17", "ema_26", "ema_35") and not n.startswith(("hh", "ll"))]


@query("technical_features", staged(HOURLY, TECH_STAGES, TECH, digits={n: 4 for n in TECH if n.startswith("bb_")}))
def technical_set(spark, sf):
    return out(technical.technical_features(hourly(spark, sf)), TECH, {n: 4 for n in TECH if n.startswith("bb_")})


BASE_SET = technical.BASE_FEATURES
BASE_STAGES = BASE + [
    {**{f"return_{k}": pct("close", k) for k in (1, 3, 5, 10, 20)}, "log_return": "lr", **{f"rsi_{k}": rsi_raw(k) for k in (7, 14, 21)}, **{f"volatility_{k}": std("lr", k) for k in (10, 20)},
     **{f"volume_ratio_{k}": grd("volume", mean("volume", k)) for k in (10, 20)}, **{f"c{k}": mean("close", k) for k in (10, 20, 50)}, "atr": mean("tr", 14), "sd": std("close", 20),
     "macd": f"{ewm('close', 12)} - {ewm('close', 26)}"},
    {"macd_signal": ewm("macd", 9), **{f"sma_dev_{k}": grd(f"close - c{k}", f"c{k}") for k in (10, 20, 50)}, "atr_norm": "atr / close", "bb_position": grd("close - c20", "2 * sd")},
    {"macd_hist": "macd - macd_signal"},
]
COMPLETE = "WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in BASE_SET)


@query("base_features", staged(HOURLY, BASE_STAGES, BASE_SET, where=COMPLETE))
def base_set(spark, sf):
    return out(technical.base_features(hourly(spark, sf)), BASE_SET)


# ------------------------------------------------------------------ labels


def class3(x, t, flat=False):
    return f"CASE WHEN {x} > {t} THEN 2 WHEN {x} < -{t} THEN 0 {'ELSE 1' if flat else f'WHEN {x} IS NOT NULL THEN 1'} END"


for _m, (_h, _t) in labels.LABELS.items():
    def _label(spark, sf, h=_h, t=_t):
        return out(labels.direction(hourly(spark, sf), h, t), ["future_return", "target"])

    query(f"label_direction_{_m}", staged(HOURLY, [{"future_return": f"{ratio(lead('close', _h), 'close')} - 1"}, {"target": class3("future_return", _t)}], ["future_return", "target"]))(_label)


@query("label_direction_compat", staged(HOURLY, [{"future_return": f"{ratio(lead('close', 6), 'close')} - 1"}, {"target": class3("future_return", 0.01, True)}], ["future_return", "target"]))
def label_compat(spark, sf):
    return out(labels.direction(hourly(spark, sf), 6, 0.01, fill_flat=True), ["future_return", "target"])


@query("label_direction_adaptive", staged(FOUR_HOURLY, [
    {"h": "least(30, greatest(1, n // 10))"}, {"later": f"lead(close, CAST(h AS INTEGER)) OVER ({W})"}, {"future_return": f"{ratio('later', 'close')} - 1"}, {"target": class3("future_return", 0.01)}],
    ["future_return", "target"]))
def label_adaptive(spark, sf):
    return out(labels.direction(four_hourly(spark, sf), 30, 0.01, adaptive=True), ["future_return", "target"])


@query("label_next_bar", staged(HOURLY, [{"future_return": f"{ratio(lead('close'), 'close')} - 1"}, {"target": class3("future_return", 0.002), "up": "CAST(future_return > 0 AS INTEGER)"}],
                                ["future_return", "target", "up"], where="WHERE future_return IS NOT NULL"))
def label_next(spark, sf):
    b = hourly(spark, sf)
    three = labels.next_bar(b)
    two = labels.next_bar(b, binary=True).select("symbol", "ts", F.col("target").alias("up"))
    return out(three.join(two, ["symbol", "ts"]), ["future_return", "target", "up"])


RISKL = ["mae_long", "mae_short", "max_adverse_excursion", "sl_hit_long", "sl_hit_short", "stop_loss_hit", "volatility_spike", "risk_score"]


def ahead(call, x, h):
    w = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count({x}) {w} = {h} THEN {call} {w} END"


@query("label_risk_score", staged(HOURLY, BASE + [
    {"mae_long": f"(close - ({ahead('min(low)', 'low', 12)})) / close", "mae_short": f"(({ahead('max(high)', 'high', 12)}) - close) / close", "sdn": std("ret", 20), "sdf": ahead("stddev_samp(ret)", "ret", 12)},
    {"max_adverse_excursion": "greatest(mae_long, mae_short)", "sl_hit_long": flag("mae_long > 0.02"), "sl_hit_short": flag("mae_short > 0.02"), "volatility_spike": flag(f"{grd('sdf', 'sdn')} > 1.5")},
    {"stop_loss_hit": "greatest(sl_hit_long, sl_hit_short)"},
    {"risk_score": "CASE WHEN max_adverse_excursion IS NOT NULL THEN least(greatest(0.4 * least(greatest(max_adverse_excursion, 0), 0.1) / 0.1 + 0.3 * stop_loss_hit + 0.3 * volatility_spike, 0), 1) END"}],
    RISKL))
def label_risk(spark, sf):
    return out(labels.risk_score(hourly(spark, sf)), RISKL)


@query("label_future_volatility", staged(HOURLY, BASE + [{"fv": ahead("stddev_samp(ret)", "ret", 20), "lv": f"({ahead('stddev_samp(lr)', 'lr', 12)}) * sqrt(252)"}], ["fv", "lv"]))
def label_future_vol(spark, sf):
    b = labels.future_volatility(hourly(spark, sf)).withColumnRenamed("future_volatility", "fv")
    return out(labels.future_volatility(b, 12, log=True).withColumnRenamed("future_volatility", "lv"), ["fv", "lv"])


# ------------------------------------------------------------------ fill, clip, scale, whole builds

SOME = ["rsi_14", "volatility_10", "volume_ratio_5", "gap"]
SOME_STAGES = BASE + [{"rsi_14": rsi_raw(14), "volatility_10": std("ret", 10), "volume_ratio_5": grd("volume", mean("volume", 5)), "gap": "(open - prev) / prev"}]


def some(spark, sf):
    from marketspark.operators.features.base import begin, guarded, rsi
    s = begin(hourly(spark, sf), halo=64, block=64)
    s.stage(rsi_14=rsi(s, 14), volatility_10=s.std("_ret", 10), volume_ratio_5=guarded("volume", s.mean("volume", 5)), gap=(F.col("open") - F.col("_prev")) / F.col("_prev"))
    return s.close()


def q_of(x, q):
    return f"quantile_cont({x}, {q}) OVER (PARTITION BY symbol)"


@query("clean_fill_no_look_ahead", staged(HOURLY, SOME_STAGES + [{f"f_{x}": f"coalesce(last_value({x} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)" for x in SOME}], [f"f_{x}" for x in SOME]))
def clean_fill(spark, sf):
    df = clean.fill(some(spark, sf), SOME)
    return out(df.withColumnsRenamed({x: f"f_{x}" for x in SOME}), [f"f_{x}" for x in SOME])


@query("clean_fill_compat", staged(HOURLY, SOME_STAGES + [{f"f_{x}": f"coalesce(last_value({x} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), "
                                   f"first_value({x} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)" for x in SOME}], [f"f_{x}" for x in SOME]))
def clean_fill_compat(spark, sf):
    df = clean.fill(some(spark, sf), SOME, look_ahead=True)
    return out(df.withColumnsRenamed({x: f"f_{x}" for x in SOME}), [f"f_{x}" for x in SOME])


@query("clean_clip_and_scale", staged(HOURLY, SOME_STAGES + [
    {f"{p}_{x}": q_of(x, v) for x in SOME for p, v in (("lo", 0.001), ("hi", 0.999))},
    {f"c_{x}": f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, lo_{x}), hi_{x}) END" for x in SOME},
    {f"z_{x}": f"(c_{x} - avg(c_{x}) OVER (PARTITION BY symbol)) / stddev_pop(c_{x}) OVER (PARTITION BY symbol)" for x in SOME}], [f"z_{x}" for x in SOME]))
def clean_clip_scale(spark, sf):
    df = clean.standard_scale(clean.clip_outer(some(spark, sf), SOME), SOME)
    return out(df.withColumnsRenamed({x: f"z_{x}" for x in SOME}), [f"z_{x}" for x in SOME])


TRAIN = "pos < floor(n * 0.8)"


@query("clean_train_only_scale", staged(HOURLY, SOME_STAGES + [
    {f"{p}_{x}": f"quantile_cont({x}, {v}) FILTER (WHERE {TRAIN}) OVER (PARTITION BY symbol)" for x in SOME for p, v in (("lo", 0.001), ("hi", 0.999))},
    {f"c_{x}": f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, lo_{x}), hi_{x}) END" for x in SOME},
    {f"z_{x}": f"(c_{x} - avg(c_{x}) FILTER (WHERE {TRAIN}) OVER (PARTITION BY symbol)) / stddev_pop(c_{x}) FILTER (WHERE {TRAIN}) OVER (PARTITION BY symbol)" for x in SOME}], [f"z_{x}" for x in SOME]))
def clean_train_scale(spark, sf):
    fit = F.expr(TRAIN)
    df = clean.standard_scale(clean.clip_outer(some(spark, sf), SOME, fit=fit), SOME, fit=fit)
    return out(df.withColumnsRenamed({x: f"z_{x}" for x in SOME}), [f"z_{x}" for x in SOME])


@query("clean_robust_scale", staged(HOURLY, SOME_STAGES + [
    {f"{p}_{x}": f"quantile_cont({x}, {v}) FILTER (WHERE {TRAIN}) OVER ()" for x in SOME for p, v in (("a", 0.25), ("m", 0.5), ("b", 0.75))},
    {f"z_{x}": f"({x} - m_{x}) / (b_{x} - a_{x})" for x in SOME}], [f"z_{x}" for x in SOME]))
def clean_robust(spark, sf):
    df = clean.robust_scale(some(spark, sf), SOME, fit=F.expr(TRAIN))
    return out(df.withColumnsRenamed({x: f"z_{x}" for x in SOME}), [f"z_{x}" for x in SOME])


_vec = staged(HOURLY, scalp_stages(True), scalp.LIVE_FEATURES).rsplit(" SELECT symbol, ts", 1)[0]
_last = "s" + str(len(scalp_stages(True)) - 1)
_ok = " AND ".join(f"{x} IS NOT NULL" for x in scalp.LIVE_FEATURES)
_stat = ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS d_{x}, arg_max({x}, pos) AS l_{x}" for x in scalp.LIVE_FEATURES)
_fin = ", ".join(f"round(coalesce((l_{x} - m_{x}) / CASE WHEN d_{x} = 0 THEN 1 ELSE d_{x} END, 0), 6) + 0.0 AS {x}" for x in scalp.LIVE_FEATURES)


@query("live_vector_scalp", f"{_vec} , g AS (SELECT symbol, max(pos) AS pos, {_stat} FROM {_last} WHERE {_ok} GROUP BY symbol) SELECT symbol, pos, {_fin} FROM g")
def live_vector(spark, sf):
    df = clean.live_vector(scalp.scalp_features(hourly(spark, sf), live=True), scalp.LIVE_FEATURES)
    return out(df, scalp.LIVE_FEATURES, keys=("symbol", "pos"))


for _m in ("scalp", "intraday", "swing"):
    def _build(spark, sf, m=_m):
        df, names = build.feature_table(hourly(spark, sf), m)
        return df.select("symbol", "ts", "target", *names)

    query(f"build_{_m}_table")(_build)


@query("build_leak_free_table")
def build_leak_free(spark, sf):
    df, names = build.leak_free_table(hourly(spark, sf), F.expr(TRAIN))
    return df.select("symbol", "ts", "target", *names)


@query("build_fast_table")
def build_fast(spark, sf):
    df, names = build.fast_table(hourly(spark, sf))
    return df.select("symbol", "ts", "target", *names)


@query("build_risk_table")
def build_risk(spark, sf):
    df, names = build.risk_table(hourly(spark, sf))
    return df.select("symbol", "ts", "risk_score", *names)
