"""Decision tables, state machines, joins and backtests against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.series import index_rows, time_bucket
from marketspark.operators import asof, backtest, bars, decide, drawdown, stats

c = F.col


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_kelly_cases(spark):
    df = rows(spark, [(.55, .02, .015), (.45, .03, .02), (.60, .015, .015), (.35, .05, .02)], "win_rate double, avg_win double, avg_loss double")
    out = decide.kelly_check(df).toPandas()
    np.testing.assert_allclose(out["full_kelly"], [.2125, .0833333333, .2, .09], atol=1e-9)
    np.testing.assert_allclose(out["constrained"], [.053125, .0208333333, .05, 0], atol=1e-9)
    neg = decide.kelly(rows(spark, [(.4, .8, .9, .02, "intraday", 1e4)], "win_rate double, payoff_ratio double, confidence double, current_volatility double, model string, capital double")).first()
    assert neg["final_size"] == 0 and neg["constraints"] == "negative_kelly"




def test_kelly_is_bounded(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.uniform(0, 1, (500, 4)), columns=["win_rate", "p", "confidence", "current_volatility"])
    pdf["payoff_ratio"], pdf["model"], pdf["capital"] = pdf["p"] * 5, "scalp", 1e4
    for mode in ("quarter", "adaptive", "half"):
        out = decide.kelly(spark.createDataFrame(pdf), mode=mode).toPandas()
        assert ((out["optimal_size"] >= 0) & (out["optimal_size"] <= 0.10 + 1e-12)).all()
        assert (out["kelly_fraction"] <= 0.25).all()


def test_ensemble_cases(spark):
    schema = "scalp_sig double, intraday_sig double, swing_sig double, risk_score double"
    cases = [(.7, .6, .5, .3), (-.7, -.6, -.5, .35), (.8, .7, .6, .75), (.2, .15, .1, .3), (.5, -.3, .2, .4), (.9, .9, .9, .7), (.9, .9, .9, .71)]
    out = [r["action"] for r in decide.ensemble_action(rows(spark, cases, schema)).collect()]
    assert out == ["LONG", "SHORT", "VETO", "HOLD", "HOLD", "LONG", "VETO"]
    ex = "scalp_dir int, intraday_dir int, swing_dir int, scalp_conf double, intraday_conf double, swing_conf double, scalp_sig double, intraday_sig double, swing_sig double"
    x = decide.exchange_signals(rows(spark, [(a, b, d, .7, .7, .7, float(a), float(b), float(d)) for a, b, d in ((1, 1, 1), (1, -1, 0), (-1, -1, 1), (1, 0, -1), (0, 0, 0))], ex)).collect()
    assert [r["has_conflict"] for r in x] == [False, True, True, True, False]


def test_drawdown_scale(spark):
    df = rows(spark, [(x,) for x in (.02, .07, .12, .18, .25)], "dd double")
    assert [r[0] for r in df.select(drawdown.step_scale(c("dd"))).collect()] == [1.0, .75, .5, .25, 0.0]
    grid = [r[0] for r in rows(spark, [(i / 1000,) for i in range(300)], "dd double").select(drawdown.multiplier(c("dd"))).collect()]
    assert all(a >= b for a, b in zip(grid, grid[1:]))


def controller(equity, initial=10_000.0):
    """The published state machine, row by row."""
    peak, worst, state = initial, 0.0, {m: "enabled" for m in drawdown.MODEL_LEVELS}
    hist, out = [initial], []
    for e in equity:
        hist.append(e)
        peak = max(peak, e)
        dd = (peak - e) / peak
        worst = max(worst, dd)
        vel = float(np.mean(np.diff([(peak - x) / peak for x in hist[-5:]]))) if len(hist) >= 5 else 0.0
        for m, (low, off) in drawdown.MODEL_LEVELS.items():
            if dd >= off:
                state[m] = "disabled"
            elif dd >= low:
                state[m] = "reduced" if state[m] == "enabled" else state[m]
            elif state[m] != "enabled" and dd < drawdown.RECOVERY:
                state[m] = "enabled"
        out.append((dd, worst, vel, worst >= drawdown.EMERGENCY, *[state[m] for m in drawdown.MODEL_LEVELS]))
    return out


def equity_frame(n=900, seed=11):
    rng = np.random.default_rng(seed)
    e = 10_000 * np.exp(np.cumsum(rng.normal(0, 0.012, n)))
    return pd.DataFrame({"account": "a", "pos": np.arange(n), "equity": e, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "reset": False})


@pytest.mark.parametrize("rows_", [64, 100_000])
def test_drawdown_states_equal_state_machine(spark, rows_):
    pdf = equity_frame()
    out = drawdown.equity_states(spark.createDataFrame(pdf), rows=rows_).toPandas().sort_values("pos")
    want = controller(pdf["equity"])
    np.testing.assert_allclose(out["current_drawdown"], [w[0] for w in want], atol=1e-12)
    np.testing.assert_allclose(out["max_drawdown"], [w[1] for w in want], atol=1e-12)
    np.testing.assert_allclose(out["drawdown_velocity"], [w[2] for w in want], atol=1e-12)
    assert list(out["emergency"]) == [w[3] for w in want]
    for i, m in enumerate(drawdown.MODEL_LEVELS):
        assert list(out[f"{m}_state"]) == [w[4 + i] for w in want]


def test_asof_never_looks_ahead_and_equals_pandas(spark):
    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"symbol": rng.choice(["hot", "hot", "x"], 300), "ts": t0 + pd.to_timedelta(rng.choice(50_000, 300, replace=False), unit="min")})
    right = pd.DataFrame({"symbol": rng.choice(["hot", "x"], 200), "ts": t0 + pd.to_timedelta(rng.choice(50_000, 200, replace=False), unit="min"), "v": rng.normal(size=200)})
    right["fact_ts"] = right["ts"]
    got = asof.asof(spark.createDataFrame(left), [asof.Facts(spark.createDataFrame(right), ["v", "fact_ts"])], fill=False, bucket_rows=50).toPandas()
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol")
    got, want = (x.sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (got, want))
    np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)
    seen = got.dropna(subset=["fact_ts"])
    assert (seen["fact_ts"] <= seen["ts"]).all()


def test_resample_equals_pandas(spark):
    rng = np.random.default_rng(4)
    n = 500
    t = pd.DataFrame({"symbol": rng.choice(["hot", "x"], n), "ts": pd.Timestamp("2024-01-03 05:00") + pd.to_timedelta(np.sort(rng.choice(2_000_000, n, replace=False)), unit="s"),
                      "price": rng.uniform(1, 2, n), "qty": rng.uniform(0, 1, n), "is_buyer_maker": rng.random(n) < .5, "id": np.arange(n)})
    for tf, rule in (("1h", "1h"), ("12h", "12h"), ("1d", "1D"), ("3d", "3D"), ("1w", "1W")):
        got = bars.resample(spark.createDataFrame(t), tf, rows=16).toPandas().sort_values(["symbol", "ts"])
        for sym, g in t.groupby("symbol"):
            r = g.set_index("ts")["price"].resample(rule)
            want = pd.DataFrame({"open": r.first(), "high": r.max(), "low": r.min(), "close": r.last()}).ffill()
            mine = got[got["symbol"] == sym]
            assert list(mine["ts"]) == list(want.index), tf
            np.testing.assert_allclose(mine[["open", "high", "low", "close"]], want)
            np.testing.assert_allclose(mine["volume"], g.set_index("ts")["qty"].resample(rule).sum())
            assert list(mine["pos"]) == list(range(len(want))) and (mine["n"] == len(want)).all()


def brute_exits(b, s):
    out = []
    for _, x in s.iterrows():
        later = b[(b["symbol"] == x["symbol"]) & (b["pos"] > x["pos"])]
        hit = ("timeout", int(b[b["symbol"] == x["symbol"]]["pos"].max()))
        for _, k in later.iterrows():
            long = x["direction"] == "LONG"
            if (k["low"] <= x["sl"]) if long else (k["high"] >= x["sl"]):
                hit = ("sl", int(k["pos"]))
                break
            if (k["high"] >= x["tp"]) if long else (k["low"] <= x["tp"]):
                hit = ("tp", int(k["pos"]))
                break
        out.append(hit)
    return out


def test_bracket_and_one_position(spark):
    rng = np.random.default_rng(9)
    frames = []
    for sym, n in (("hot", 5000), ("x", 300)):
        cl = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        frames.append(pd.DataFrame({"symbol": sym, "pos": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), "open": cl, "high": cl * 1.004, "low": cl * 0.996, "close": cl}))
    b = pd.concat(frames, ignore_index=True)
    s = b.sample(120, random_state=1).copy()
    s["direction"] = rng.choice(["LONG", "SHORT"], len(s))
    w = rng.choice([0.01, 0.05, 0.3], len(s))
    s["entry"] = s["close"]
    s["sl"] = np.where(s["direction"] == "LONG", s["close"] * (1 - w), s["close"] * (1 + w))
    s["tp"] = np.where(s["direction"] == "LONG", s["close"] * (1 + 2 * w), s["close"] * (1 - 2 * w))
    s = s[["symbol", "pos", "ts", "direction", "entry", "sl", "tp"]]
    want = s.assign(want=brute_exits(b, s))
    out = backtest.bracket_outcomes(spark.createDataFrame(s), spark.createDataFrame(b))
    got = out.toPandas().merge(want[["symbol", "pos", "want"]], on=["symbol", "pos"])
    assert len(got) == len(s)
    assert [(a, int(p)) for a, p in zip(got["exit_reason"], got["exit_pos"])] == list(got["want"])
    for piece in (7, 100_000):
        taken = backtest.one_position(out, rows=piece).toPandas()
        expect = set()
        for sym, g in want.sort_values("pos").groupby("symbol"):
            free = -1
            for _, x in g.iterrows():
                if x["pos"] >= free:
                    expect.add((sym, x["pos"]))
                    free = 2**62 if x["want"][0] == "timeout" else x["want"][1]
        assert set(zip(taken["symbol"], taken["pos"])) == expect


def test_cvar_is_at_least_var(spark):
    rng = np.random.default_rng(42)
    r = np.concatenate([rng.normal(0, .02, 200), rng.normal(-.10, .02, 10)])
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "k": np.arange(len(r)), "r": r}))
    t = stats.recent_tail_risk(df, ["model"], "r", ["k"]).first()
    losses = -r
    v = np.percentile(losses, 95)
    assert t["cvar"] >= t["var"]
    np.testing.assert_allclose([t["var"], t["cvar"]], [v, losses[losses >= v].mean()])
    few = stats.recent_tail_risk(df.limit(10), ["model"], "r", ["k"]).first()
    assert few["cvar"] == 0.08 and few["is_blocked"] and few["risk_level"] == "blocked"


def test_select_uncorrelated_equals_greedy(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 24))
    r = {f"s{i:02d}": base[i % 4] + rng.normal(size=24) * (0.3 if i % 2 else 2.0) for i in range(20)}
    ranked = spark.createDataFrame([(s, i + 1) for i, s in enumerate(r)], "symbol string, rank int")
    ret = spark.createDataFrame([(s, [float(x) for x in v]) for s, v in r.items()], "symbol string, r array<double>")
    got = [x["symbol"] for x in decide.select_uncorrelated(ranked, ret, top=5).orderBy("rank").collect()]
    want = []
    for s, v in r.items():
        if all(abs(np.corrcoef(v, r[k])[0, 1]) <= 0.7 for k in want):
            want.append(s)
    assert got == want[:5]


def test_worst_tail_counts_ties(spark):
    v = [-5.0] * 7 + [float(i) for i in range(393)]
    df = spark.createDataFrame([("a", x) for x in v], "g string, v double")
    out = stats.worst_tail_mean(df, ["g"], "v").first()
    assert out["n_tail"] == 4 and out["worst_tail_mean"] == -5.0


def test_index_rows_is_dense(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.timestamp_seconds(c("id") * 3600).alias("ts"))
    pos = [r["pos"] for r in index_rows(df, ["k"], ["ts"], time_bucket("ts", 86_400)).orderBy("ts").collect()]
    assert pos == list(range(1000))


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from marketspark.session import runs_here, shared_folder

    assert runs_here("local") and runs_here("local[*]") and runs_here("local[4,2]")
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        context.master = master
        with pytest.raises(RuntimeError):
            shared_folder(away)
    away.conf.get = lambda *_: "hdfs://shared"
    assert shared_folder(away) == "hdfs://shared"


def test_csv_by_header_keeps_every_row(spark, tmp_path):
    from marketspark.sources import files

    (tmp_path / "klines_usdt_m_AUSDT_1h.csv").write_text('symbol,timestamp,open,high,low,close,volume\nAUSDT,1000,1,2,0.5,1.5,10\nAUSDT,2000,-1,2,0.5,1.5,10\n')
    (tmp_path / "klines_usdt_m_BUSDT_1h.csv").write_text('volume,"close","timestamp",open,note\n"3",-2.5, 3000,"7","a, b"\n 4,1,4000,8,"say ""x"""\n,,5000,,\n')
    (tmp_path / "klines_usdt_m_BUSDT_5m.csv").write_text("timestamp,open\n6000,1\n")
    rows = {(r["symbol"], r["timeframe"], r["ts"].second): (r["open"], r["close"], r["volume"]) for r in files.scan_klines(spark, str(tmp_path)).collect()}
    assert rows == {("AUSDT", "1h", 1): (1, 1.5, 10), ("AUSDT", "1h", 2): (-1, 1.5, 10), ("BUSDT", "1h", 3): (7, -2.5, 3), ("BUSDT", "1h", 4): (8, 1, 4),
                    ("BUSDT", "1h", 5): (None, None, None), ("BUSDT", "5m", 6): (1, None, None)}
    assert files.scan_klines(spark, str(tmp_path), "BUSDT", "5m").count() == 1
    assert files.scan_family(spark, str(tmp_path), "funding_rate").count() == 0


def test_last_bins_equal_those_of_the_whole_series(spark):
    rng = np.random.default_rng(8)
    n = 120
    t = spark.createDataFrame(pd.DataFrame({
        "symbol": rng.choice(["hot", "x", "y"], n, p=[.9, .05, .05]), "ts": pd.Timestamp("2024-01-03 05:00") + pd.to_timedelta(np.sort(rng.choice(900_000, n, replace=False)), unit="s"),
        "price": rng.uniform(1, 2, n), "qty": rng.uniform(0, 1, n), "is_buyer_maker": rng.random(n) < .5, "id": np.arange(n)}))
    whole = bars.resample(t, "1h", rows=16)
    order = ["symbol", "ts"]
    for last in (1, 25, 10_000):
        got = bars.resample(t, "1h", rows=16, last=last).toPandas().sort_values(order, ignore_index=True)
        want = whole.filter(c("pos") >= c("n") - last).toPandas().sort_values(order, ignore_index=True)
        pd.testing.assert_frame_equal(got, want)


def test_last_returns_sort_no_series(spark):
    b = spark.range(200).select(F.concat(F.lit("s"), (c("id") % 3).cast("string")).alias("symbol"), F.timestamp_seconds(c("id") * 60).alias("ts"), F.floor(c("id") / 3).alias("pos"),
                                F.when(c("id") % 3 < 2, 67).otherwise(66).alias("n"), (c("id") * 37 % 101 + 1.0).alias("close"))
    new, old = asof.last_returns(b), asof.last_returns(b.drop("n"))
    assert "Window" not in new._jdf.queryExecution().toString() and "Window" in old._jdf.queryExecution().toString()
    assert {r["symbol"]: list(r["r"]) for r in new.collect()} == {r["symbol"]: list(r["r"]) for r in old.collect()}


@pytest.mark.parametrize("block", [3, 4_096])
def test_pair_products_equal_numpy(spark, block):
    rng = np.random.default_rng(5)
    names = [f"s{i}" for i in rng.permutation(23)]
    r = rng.normal(0, .01, (23, 24))
    r[4], r[9], r[11] = 0.0, r[2], -r[3]  # a constant series, a copy, a mirror image
    df = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, r)], "symbol string, r array<double>")
    with np.errstate(invalid="ignore"):
        m = np.nan_to_num(np.corrcoef(r))
    want = {(a, b): m[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if a < b}
    for above in (None, 0.3):
        rows_ = asof.pair_correlations(df, above, block).collect()
        got = {(x["symbol_1"], x["symbol_2"]): x["corr"] for x in rows_}
        keep = {k: v for k, v in want.items() if above is None or abs(v) > above}
        assert len(rows_) == len(got) and got.keys() == keep.keys() and all(abs(got[k] - v) < 1e-12 for k, v in keep.items())


def shuffled(spark, df) -> int:
    """Bytes that the session's tasks write for other tasks while ``df`` is computed."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


def test_pair_products_copy_no_block(spark):
    n = 400
    r = spark.range(n).select(F.concat(F.lit("s"), c("id").cast("string")).alias("symbol"), F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.xxhash64("id", i) % 10_007 / 10_007).alias("r"))
    # a few times the returns themselves, not once a block
    assert shuffled(spark, lambda: asof.pair_correlations(r, block=n // 16)) < 6 * n * 24 * 8


def test_pair_products_in_few_parts(spark, monkeypatch):
    monkeypatch.setattr(asof, "PAIR_PARTS", 3)
    r = spark.range(23).select(F.concat(F.lit("s"), c("id").cast("string")).alias("symbol"), F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.xxhash64("id", i) % 10_007 / 10_007).alias("r"))
    one, many = ({(x["symbol_1"], x["symbol_2"]): round(x["corr"], 9) for x in asof.pair_correlations(r, block=b).collect()} for b in (4_096, 2))
    df = asof.pair_correlations(r, block=2)
    assert len(one) == 253 and one == many and df.count() == 253 and df.rdd.getNumPartitions() == 9


def test_last_bins_shuffle_only_their_ticks(spark):
    n = 60_000
    h = lambda i: F.abs(F.xxhash64("id", F.lit(i)))
    t = spark.range(n).select((c("id") % 3).cast("string").alias("symbol"), F.timestamp_seconds(h(1) % 50_000_000).alias("ts"), (h(2) % 1_000 / 10.0 + 1).alias("price"),
                              (h(3) % 1_000 / 7.0).alias("qty"), (h(4) % 2 == 0).alias("is_buyer_maker"), "id")
    assert shuffled(spark, lambda: bars.resample(t, "1h", last=25)) < shuffled(spark, lambda: bars.resample(t, "1h")) / 10
