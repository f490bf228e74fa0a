"""Rolling order statistics and variable windows of a piece against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.series import Pieces
from marketspark.functions.windows import Ranges, Wavelet


def values(kind, n, rng):
    return {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "equal": np.full(n, 2.5), "falling": -np.arange(n, dtype=float)}[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "equal", "falling"])
@pytest.mark.parametrize("n", [1, 2, 7, 64, 200])
def test_wavelet(kind, n):
    rng = np.random.default_rng(n)
    v = values(kind, n, rng)
    w = Wavelet(v)
    lo = rng.integers(0, n, 300)
    hi = np.minimum(n, lo + 1 + rng.integers(0, n, 300))
    k = (rng.random(300) * (hi - lo)).astype(int)
    assert w.kth(lo, hi, k).tolist() == [np.sort(v[a:b])[i] for a, b, i in zip(lo, hi, k)]
    bound = rng.choice(np.concatenate((v, [v.min() - 1, v.max() + 1])), 300)
    for side, fn in (("left", np.less), ("right", np.less_equal)):
        count, total = w.below(lo, hi, bound, side)
        assert count.tolist() == [int(fn(v[a:b], x).sum()) for a, b, x in zip(lo, hi, bound)]
        np.testing.assert_allclose(total, [v[a:b][fn(v[a:b], x)].sum() for a, b, x in zip(lo, hi, bound)], atol=1e-9)


@pytest.mark.parametrize("kind", ["normal", "ties", "equal"])
@pytest.mark.parametrize("holes", [0.0, 0.1])
def test_rolls(kind, holes):
    rng = np.random.default_rng(3)
    v = pd.Series(values(kind, 150, rng))
    v[rng.random(150) < holes] = np.nan
    r = Ranges(v.fillna(0).to_numpy(), v.notna().to_numpy())
    for k in (2, 5, 50, 150):
        roll = v.rolling(k)
        want = {"mean": roll.mean(), "sum": roll.sum(), "std": roll.std(), "min": roll.min(), "max": roll.max(), "quantile": roll.quantile(0.05), "lag": v.shift(k),
                "tail_mean": roll.apply(lambda x: x[x <= np.quantile(x, 0.05)].mean(), raw=True)}
        for name, series in want.items():
            got, good = r.roll(name, np.full(150, k), 0.05)
            np.testing.assert_allclose(np.where(good, got, np.nan), series, atol=1e-9, err_msg=f"{name} {k}")
    got, good = r.roll("share_below", np.full(150, 40), None)
    for i in range(150):
        past = v[max(0, i - 40):i].dropna()
        if good[i]:
            lt, le = (past < v[i]).sum(), (past <= v[i]).sum()
            assert abs(got[i] - (lt + le + (le > lt)) / 2 / len(past)) < 1e-12
        else:
            assert np.isnan(v[i]) or not len(past)


def test_lengths_from_a_column(spark):
    """Windows of up to the halo, across pieces, one length per row; a longer one is refused."""
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"symbol": "s", "pos": np.arange(400), "close": rng.normal(size=400), "k": rng.integers(1, 90, 400)})
    s = Pieces(spark.createDataFrame(p), halo=100, rows=128)
    k = F.col("k").cast("int")
    s.stage(mean=s.mean("close", k), median=s.median("close", k), top=s.max("close", k), back=s.lag("close", k), std=s.std("close", k))
    got = s.close().toPandas().sort_values("pos").reset_index(drop=True)
    x = p["close"]
    for i in range(400):
        n, w = p["k"][i], x[max(0, i + 1 - p["k"][i]):i + 1]
        full = i + 1 >= n
        for name, want in (("mean", w.mean()), ("median", w.median()), ("top", w.max()), ("std", w.std())):
            assert (abs(got[name][i] - want) < 1e-9) if full and not np.isnan(want) else np.isnan(got[name][i]), (name, i)
        assert (got["back"][i] == x[i - n]) if i >= n else np.isnan(got["back"][i])
    long = Pieces(spark.createDataFrame(p), halo=100, rows=128)
    long.stage(m=long.mean("close", F.lit(300).cast("int")))
    with pytest.raises(Exception, match="longer than the halo"):
        long.close().collect()
