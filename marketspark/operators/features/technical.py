"""The wide technical set (about 200 columns) and the small base set for model checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import begin, guarded, ratio, rsi
from ...functions.series import Pieces

PERIODS = (3, 5, 7, 10, 14, 20, 30, 50, 100, 200)


def technical_features(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Averages of span 200 need a long memory, so blocks and halos are wider here.

    Short spans use their own short blocks (the weights of a long block would overflow).
    """
    s = begin(bars, rows=rows, halo=8192, block=4096)
    c = F.col("close")
    s.expanding(obv=("sum", F.signum("_delta") * F.col("volume")))
    s.moments("_ret", 10, 20, 50, 100)
    s.stage(**{f"_p{k}": s.lag("close", k) for k in PERIODS})
    s.stage(
        **{f"sma_{k}": s.mean("close", k) for k in PERIODS},
        **{f"std_{k}": s.std("close", k) for k in PERIODS},
        **{f"return_{k}": ratio("close", f"_p{k}") - 1 for k in PERIODS},
        **{f"log_return_{k}": F.log(ratio("close", f"_p{k}")) for k in PERIODS},
        **{f"rsi_{k}": rsi(s, k, live=True) for k in (5, 7, 9, 14, 21, 28)},
        **{f"atr_{k}": s.mean(F.col("high") - F.col("low"), k) for k in (5, 10, 14, 20, 30, 50)},
        **{f"_hh{k}": s.max("high", k) for k in (14, 28)},
        **{f"_ll{k}": s.min("low", k) for k in (14, 28)},
        **{f"volume_sma_{k}": s.mean("volume", k) for k in (5, 10, 20, 50)},
        **{f"volume_std_{k}": s.std("volume", k) for k in (5, 10, 20, 50)},
        **{f"skew_{k}": s.skew("_ret", k, bias=True) for k in (10, 20, 50, 100)},
        **{f"close_lag_{k}": s.lag("close", k) for k in (1, 2, 3, 5, 10)},
        **{f"return_lag_{k}": s.lag("_ret", k) for k in (1, 2, 3, 5, 10)},
        **{f"volume_lag_{k}": s.lag("volume", k) for k in (1, 2, 3, 5, 10)},
    )
    decayed_averages(s)
    band = lambda k, m, sign: F.col(f"sma_{k}") + sign * m * F.col(f"std_{k}")
    s.stage(
        **{f"bb_upper_{k}_{m}".replace(".", "_"): band(k, m, 1) for k in (10, 20, 50) for m in (1.5, 2.0, 2.5, 3.0)},
        **{f"bb_lower_{k}_{m}".replace(".", "_"): band(k, m, -1) for k in (10, 20, 50) for m in (1.5, 2.0, 2.5, 3.0)},
        obv_sma_20=s.mean("obv", 20), obv_slope=s.diff("obv", 5) / 5,
    )
    out = {}
    for k in (5, 10, 20, 50):
        p = F.col("_p5" if k == 5 else f"_p{k}")
        out[f"roc_{k}"] = guarded(c - p, p) * 100
        out[f"momentum_{k}"] = c - p
        out[f"volume_ratio_{k}"] = guarded("volume", f"volume_sma_{k}")
    for k in (5, 10, 14, 20, 30, 50):
        out[f"natr_{k}"] = guarded(f"atr_{k}", "close") * 100
    for k in (14, 28):
        out[f"williams_r_{k}"] = -100 * guarded(F.col(f"_hh{k}") - c, F.col(f"_hh{k}") - F.col(f"_ll{k}"))
    for k in (10, 20, 50):
        for m in ("1_5", "2_0", "2_5", "3_0"):
            up, low = F.col(f"bb_upper_{k}_{m}"), F.col(f"bb_lower_{k}_{m}")
            out[f"bb_width_{k}_{m}"] = guarded(up - low, f"sma_{k}")
            out[f"bb_pct_{k}_{m}"] = guarded(c - low, up - low)
    for k in (10, 20, 50, 100):
        out[f"zscore_{k}"] = guarded(c - F.col(f"sma_{k}"), f"std_{k}")
    for a, b in ((5, 20), (10, 50), (20, 100)):
        out[f"sma_{a}_{b}_cross"] = (F.col(f"sma_{a}") > F.col(f"sma_{b}")).cast("float")
    for k in (20, 50):
        out[f"price_sma_{k}_cross"] = (c > F.col(f"sma_{k}")).cast("float")
    span = F.col("high") - F.col("low")
    out["body_size"] = guarded(F.abs(c - F.col("open")), span)
    out["upper_shadow"] = guarded(F.col("high") - F.greatest("close", "open"), span)
    out["lower_shadow"] = guarded(F.least("close", "open") - F.col("low"), span)
    out["is_bullish"] = (c > F.col("open")).cast("float")
    out["is_doji"] = (guarded(F.abs(c - F.col("open")), span) < 0.1).cast("float")
    return s.stage(**out).close()


#: Fixed values: (fast, slow, signal) spans.
MACD_SETS = ((12, 26, 9), (5, 35, 5), (8, 17, 9))


def decayed_averages(s: Pieces) -> Pieces:
    """EMA of every period and three MACD sets; two block lengths cover all spans."""
    spans = sorted({*PERIODS, *(x for f, sl, _ in MACD_SETS for x in (f, sl))})
    short, long_ = [k for k in spans if k <= 26], [k for k in spans if k > 26]

    def with_block(block, names, source="close"):
        s.block = block
        s.stage(_blk=F.floor(F.col(s.pos) / block).cast("long"))
        s.stage(**{n: s.ewm(src, span) for n, (src, span) in names.items()})

    with_block(4096, {f"ema_{k}": ("close", k) for k in long_})
    with_block(512, {f"ema_{k}": ("close", k) for k in short})
    s.stage(**{f"macd_{f}_{sl}": F.col(f"ema_{f}") - F.col(f"ema_{sl}") for f, sl, _ in MACD_SETS})
    s.stage(**{f"macd_signal_{f}_{sl}": s.ewm(f"macd_{f}_{sl}", sig) for f, sl, sig in MACD_SETS})
    s.stage(**{f"macd_hist_{f}_{sl}": F.col(f"macd_{f}_{sl}") - F.col(f"macd_signal_{f}_{sl}") for f, sl, _ in MACD_SETS})
    extra = [k for k in spans if k not in PERIODS]
    s.df = s.df.drop(*[f"ema_{k}" for k in extra])
    return s


def base_features(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Small set for baseline models; incomplete rows are dropped."""
    s = begin(bars, rows=rows)
    c = F.col("close")
    s.stage(
        **{f"return_{k}": s.pct("close", k) for k in (1, 3, 5, 10, 20)}, log_return=F.col("_lr"),
        **{f"rsi_{k}": rsi(s, k) for k in (7, 14, 21)},
        **{f"volatility_{k}": s.vol("_lr", k) for k in (10, 20)},
        **{f"volume_ratio_{k}": guarded("volume", s.mean("volume", k)) for k in (10, 20)},
        **{f"_s{k}": s.mean("close", k) for k in (10, 20, 50)},
        _e12=s.ewm("close", 12), _e26=s.ewm("close", 26), atr=s.mean("_tr", 14), _sd=s.std("close", 20),
    )
    s.stage(macd=F.col("_e12") - F.col("_e26"))
    s.stage(macd_signal=s.ewm("macd", 9))
    s.stage(
        **{f"sma_dev_{k}": guarded(c - F.col(f"_s{k}"), f"_s{k}") for k in (10, 20, 50)},
        macd_hist=F.col("macd") - F.col("macd_signal"), atr_norm=ratio("atr", "close"),
        bb_position=guarded(c - F.col("_s20"), 2 * F.col("_sd")),
    )
    return s.close().dropna(subset=BASE_FEATURES)


#: Columns of the base set.
BASE_FEATURES = [
    "return_1", "return_3", "return_5", "return_10", "return_20", "log_return", "rsi_7", "rsi_14", "rsi_21",
    "volatility_10", "volatility_20", "volume_ratio_10", "volume_ratio_20", "sma_dev_10", "sma_dev_20", "sma_dev_50",
    "macd", "macd_signal", "macd_hist", "atr", "atr_norm", "bb_position",
]
