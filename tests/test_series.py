"""Rolling, decaying and expanding values against pandas, on series cut into many pieces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.quantiles import exact_quantiles
from marketspark.functions.series import Pieces, index_rows, running, time_bucket

N = 700


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    rows = []
    for sym, n in (("hot", N), ("b", 90), ("c", 5)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows.append(pd.DataFrame({"symbol": sym, "pos": np.arange(n), "close": close, "volume": rng.exponential(10, n)}))
    return pd.concat(rows, ignore_index=True)


def per_symbol(frame, fn):
    return pd.concat([fn(g["close"].reset_index(drop=True)) for _, g in frame.groupby("symbol", sort=True)]).to_numpy()


def run(spark, frame, stages, halo=64, rows=64, block=64):
    s = Pieces(spark.createDataFrame(frame), halo=halo, rows=rows, block=block)
    for st in stages:
        st(s)
    return s.close().toPandas().sort_values(["symbol", "pos"]).reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(dtype=float), np.asarray(want, dtype=float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rolling_over_piece_borders(spark, frame):
    out = run(spark, frame, [lambda s: s.stage(
        ret=s.pct("close"), m=s.mean("close", 10), sd=s.std("close", 20), mx=s.max("close", 50), med=s.median("close", 15),
        q=s.quantile("close", 0.05, 30), sl=s.slope("close", 12), d5=s.nth_diff("close", 5))])
    same(out["ret"], per_symbol(frame, lambda c: c.pct_change()))
    same(out["m"], per_symbol(frame, lambda c: c.rolling(10).mean()))
    same(out["sd"], per_symbol(frame, lambda c: c.rolling(20).std()))
    same(out["mx"], per_symbol(frame, lambda c: c.rolling(50).max()))
    same(out["med"], per_symbol(frame, lambda c: c.rolling(15).median()))
    same(out["q"], per_symbol(frame, lambda c: c.rolling(30).quantile(0.05)))
    same(out["sl"], per_symbol(frame, lambda c: c.rolling(12).apply(lambda y: np.polyfit(np.arange(12), y, 1)[0])))
    same(out["d5"], per_symbol(frame, lambda c: pd.Series(np.concatenate([[np.nan] * min(5, len(c)), np.diff(c, n=5)])[: len(c)])))


def test_moments_of_returns(spark, frame):
    out = run(spark, frame, [lambda s: s.stage(ret=s.pct("close")), lambda s: s.moments("ret", 20),
                             lambda s: s.stage(v=s.vol("ret", 20), sk=s.skew("ret", 20), ku=s.kurt("ret", 20))])
    r = lambda c: c.pct_change().rolling(20)
    same(out["v"], per_symbol(frame, lambda c: r(c).std()))
    np.testing.assert_allclose(out["sk"], per_symbol(frame, lambda c: r(c).skew()), rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(out["ku"], per_symbol(frame, lambda c: r(c).kurt()), rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("span", [3, 12, 26])
def test_decaying_averages(spark, frame, span):
    out = run(spark, frame, [lambda s: s.stage(a=s.ewm("close", span), b=s.ewm("close", span, adjust=False))], halo=512, rows=512, block=512)
    same(out["a"], per_symbol(frame, lambda c: c.ewm(span=span).mean()))
    same(out["b"], per_symbol(frame, lambda c: c.ewm(span=span, adjust=False).mean()))


def test_decay_that_does_not_fit_is_refused(spark, frame):
    s = Pieces(spark.createDataFrame(frame), halo=64, rows=64, block=64)
    with pytest.raises(ValueError):
        s.ewm("close", 200)


def test_expanding_values_and_rolling_over_them(spark, frame):
    out = run(spark, frame, [lambda s: s.stage(d=s.diff("close")),
                             lambda s: s.expanding(cs=("sum", F.col("d")), top=("max", F.col("close")), last=("last", F.when(F.col("pos") % 150 == 3, F.col("close")))),
                             lambda s: s.stage(m=s.mean("cs", 10))])
    same(out["cs"], per_symbol(frame, lambda c: c.diff().cumsum()))
    same(out["top"], per_symbol(frame, lambda c: c.cummax()))
    same(out["m"], per_symbol(frame, lambda c: c.diff().cumsum().rolling(10).mean()))
    same(out["last"], per_symbol(frame, lambda c: c.where(np.arange(len(c)) % 150 == 3).ffill()))


def test_forward_frames(spark, frame):
    s = Pieces(spark.createDataFrame(frame), halo=1, ahead=12, rows=64)
    s.stage(lo=s.ahead(F.min, "close", 12), nx=s.lead("close", 6))
    out = s.close().toPandas().sort_values(["symbol", "pos"])
    same(out["lo"], per_symbol(frame, lambda c: c.rolling(12).min().shift(-12)))
    same(out["nx"], per_symbol(frame, lambda c: c.shift(-6)))


def test_adaptive_length_equals_constant(spark, frame):
    s = Pieces(spark.createDataFrame(frame), halo=256, rows=256)
    k = F.lit(9)
    s.stage(a=s.mean("close", k), b=s.mean("close", 9), c=s.std("close", k), d=s.std("close", 9), e=s.median("close", k), f=s.median("close", 9), g=s.pct("close", k), h=s.pct("close", 9))
    out = s.close().toPandas()
    for x, y in ("ab", "cd", "ef", "gh"):
        same(out[x], out[y])


def test_running_and_index_over_buckets(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["hot"] * 400 + ["x"] * 20, "t": list(rng.permutation(400)) + list(range(20)), "v": rng.normal(size=420)})
    df = spark.createDataFrame(pdf)
    out = index_rows(df, ["k"], ["t"], F.floor(F.col("t") / 16), total="n")
    out = running(out, ["k"], ["t"], F.floor(F.col("t") / 16), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.when(F.col("t") % 37 == 0, F.col("v")))}).toPandas()
    want = pdf.sort_values(["k", "t"])
    g = want.groupby("k")["v"]
    out = out.sort_values(["k", "t"])
    assert (out["pos"].to_numpy() == want.groupby("k").cumcount().to_numpy()).all()
    assert (out["n"].to_numpy() == want.groupby("k")["v"].transform("size").to_numpy()).all()
    same(out["s"], g.cumsum())
    same(out["m"], g.cummax())
    same(out["l"], want["v"].where(want["t"] % 37 == 0).groupby(want["k"]).ffill())


@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "two"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    v = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 5, 3000).astype(float), "constant": np.ones(500), "two": np.array([1.0, 2.0])}[kind]
    probs = [0.0, 0.001, 0.05, 0.25, 0.5, 0.95, 0.999, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * len(v), "v": v}))
    q = exact_quantiles(df, ["g"], ["v"], probs).first()
    np.testing.assert_allclose(q["q"], np.percentile(v, [p * 100 for p in probs]), rtol=1e-12)
    assert q["n"] == len(v)


def test_time_bucket_is_monotone(spark):
    df = spark.sql("select timestamp_seconds(id * 777) ts from range(200)")
    b = [r[0] for r in df.select(time_bucket("ts", 3600)).orderBy("ts").collect()]
    assert b == sorted(b)
