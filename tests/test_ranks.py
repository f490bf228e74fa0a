"""Exact ranks by narrowing intervals against numpy: one huge group, hot values, distinct values, nulls, many columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions import quantiles
from marketspark.operators import stats

PROBS = [0.001, 0.5, 1.0]


def sample(n=6000):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "a", "b"], n), "x": rng.normal(size=n), "y": np.round(rng.normal(size=n), 1), "z": rng.choice([0.0, 0.0, 0.0, 5.0], n)})
    x.loc[rng.random(n) < 0.2, "y"] = None
    x.loc[x["k"] == "b", "z"] = None
    return x


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("bound", [40, 1 << 16])
def test_quantiles(spark, keys, bound):
    p = sample()
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "k string, x double, y double, z double").repartition(5)
    got = {tuple(r[k] for k in keys) + (r["column"],): (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, keys, ["x", "y", "z"], PROBS, bound=bound).collect()}
    groups = p.groupby("k") if keys else [((), p)]
    want = {}
    for key, g in groups:
        for c in ("x", "y", "z"):
            v = g[c].dropna()
            if len(v):
                want[((key,) if keys else ()) + (c,)] = (len(v), np.quantile(v, PROBS))
    assert set(got) == set(want)
    for k, (n, q) in want.items():
        assert got[k][0] == n
        np.testing.assert_allclose(got[k][1], q, rtol=0, atol=1e-12, err_msg=str(k))


def test_no_task_gathers_a_group(spark, monkeypatch):
    """One group of distinct values: the last step gathers no more than the bound for each wanted rank."""
    held = []
    real = quantiles.F.sort_array
    monkeypatch.setattr(quantiles.F, "sort_array", lambda a: held.append(a) or real(a))
    df = spark.range(0, 20_000, 1, 8).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    tables = []
    keep = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda d, name: tables.append((name, keep(d, name))) or tables[-1][1])
    got = quantiles.exact_quantiles(df, ["k"], ["v"], [0.1, 0.77], bound=50).first()
    np.testing.assert_allclose(got["q"], np.quantile(np.arange(20_000, dtype=np.int64) * 7919 % 20_011, [0.1, 0.77]))
    last = [t for name, t in tables if name == "rank-intervals"][-1].first()
    assert len(held) == 1 and max(last[f"_in0_{m}"] for m in range(4)) <= 50
    assert len([1 for name, _ in tables if name == "rank-intervals"]) <= 4


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), (None, 2.0), (None, 4.0)], "k string, v double")
    for bound in (1, 100):
        got = {r["k"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, ["k"], ["v"], [0.5], bound=bound).collect()}
        assert got == {"b": (1, [1.0]), None: (2, [3.0])}
    assert quantiles.exact_quantiles(df.limit(0), ["k"], ["v"], [0.5]).count() == 0
    assert quantiles.exact_quantiles(df.limit(0), [], ["v"], [0.5]).count() == 0


@pytest.mark.parametrize("bucket", [7, 100, 1 << 18])
def test_distinct_counts_and_auc(spark, bucket, monkeypatch):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"k": "g", "s": np.round(rng.normal(size=3000), 2), "y": rng.random(3000) < 0.3})
    df = spark.createDataFrame(p)
    v = quantiles.distinct_counts(df, ["k"], "s", bucket_rows=bucket, up=F.col("y").cast("int")).toPandas().sort_values("s")
    assert (np.diff(v["b"]) >= 0).all() and v["c"].sum() == 3000 and v["up"].sum() == p["y"].sum()
    assert bucket > 3000 or v.groupby("b").size().max() <= max(4 * bucket, 12)
    whole = quantiles.distinct_counts
    monkeypatch.setattr(stats, "distinct_counts", lambda *a, **k: whole(*a, bucket_rows=bucket, **k))
    got = stats.auc(df, ["k"], "s", F.col("y")).first()["auc"]
    up, down = p.loc[p["y"], "s"].to_numpy(), p.loc[~p["y"], "s"].to_numpy()
    want = (np.sign(up[:, None] - down[None, :]) + 1).mean() / 2
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize("rows", [13, 200, 1 << 18])
def test_asof_at_any_density(spark, rows):
    """A symbol with nearly all ticks in one hour is many buckets, with the values of one scan."""
    from marketspark.operators import asof

    rng = np.random.default_rng(8)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.concatenate((rng.integers(0, 3600, 900), rng.integers(0, 86_400 * 60, 100))), unit="s")
    facts = pd.DataFrame({"symbol": np.where(np.arange(1000) % 10 == 0, "b", "hot"), "ts": at, "v": np.where(rng.random(1000) < 0.2, None, rng.normal(size=1000))}).drop_duplicates(["symbol", "ts"])
    bars = pd.DataFrame({"symbol": np.repeat(["hot", "b", "none"], 200), "ts": np.tile(pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(200) * 29, unit="s"), 3)})
    f = spark.createDataFrame(facts.astype({"v": object}), "symbol string, ts timestamp, v double")
    for fill in (True, False):
        got = asof.asof(spark.createDataFrame(bars), [asof.Facts(f, ["v"])], fill=fill, bucket_rows=rows).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
        facts["v"] = facts["v"].astype(float)
        want = pd.merge_asof(bars.sort_values("ts"), facts.sort_values("ts"), on="ts", by="symbol").sort_values(["symbol", "ts"]).reset_index(drop=True)
        if fill:
            want["v"] = want.groupby("symbol")["v"].ffill()
        assert list(got.columns) == ["symbol", "ts", "v"]
        np.testing.assert_allclose(got["v"].astype(float), want["v"].astype(float))
    if rows < 1000:
        sizes = quantiles.depth_bucket(f, ["symbol"], "ts", "d", rows).groupBy("symbol", "d").count().toPandas()
        assert sizes["count"].max() <= 4 * rows and sizes[sizes["symbol"] == "hot"]["d"].nunique() > 2


def test_rows_do_not_meet_by_group(spark):
    """A few large groups: the quantile comes to the rows, which stay where they are."""
    df = spark.range(0, 140_000, 1, 8).select((F.col("id") % 2).alias("k"), (F.floor(F.col("id") / 2) * 7919 % 70_001).cast("double").alias("v"))
    plan = stats.with_quantile(df, ["k"], "v", 0.05, "q")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = stats.return_tail(df, ["k"], "v").first()  # both groups hold the same values
    v = np.arange(70_000, dtype=np.int64) * 7919 % 70_001
    assert got["n"] == 70_000 and abs(got["var"] - np.quantile(v, 0.05)) < 1e-6 and got["n_tail"] == (v <= np.quantile(v, 0.05)).sum()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_do_not_meet_by_key_for_their_split_points(spark):
    """A few keys with very many rows each: no task may get all rows of one."""
    df = spark.range(300_000).select((F.col("id") % 3).alias("k"), F.timestamp_micros("id").alias("ts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        assert "SortMergeJoin" not in plan(quantiles.depth_bucket(df, ["k"], "ts", "b", 10_000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_do_not_meet_by_key_for_the_totals_of_decisions(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("pos"), (F.hash("id") % 100 / 1000).alias("r"), F.lit("approved").alias("decision"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        joins = [x for x in plan(stats.decision_statistics(df, ["k"])).splitlines() if "SortMergeJoin" in x]
        assert all("_piece" in x for x in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trades_are_numbered_in_buckets_of_a_day(spark):
    from workload.risk_queries import indexed

    assert "/ 86400" in plan(indexed(spark, "/root/testdata/sf0.001")) or "/ 86400.0" in plan(indexed(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("bound", [40, 1 << 16])
def test_infinite_values_keep_their_rank(spark, bound):
    """Narrowed intervals with an open end hold the infinities, whose ranks count like any other."""
    v = np.concatenate((np.full(20, -np.inf), np.arange(300.0) * 7 % 301, np.full(30, np.inf)))
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double").repartition(4)
    at = [0, 10, 19, 20, 21, 170, 319, 320, 349]
    got = quantiles.values_at(df, ["k"], ["v"], lambda n: [F.lit(i) for i in at], bound=bound).first()["q"]
    assert got == np.sort(v)[at].tolist()


@pytest.mark.parametrize("rows", [400, 140_000])
def test_worst_tail_of_a_null_group(spark, rows):
    """A null key is a group, as in SQL, and few large groups do not meet by key."""
    df = spark.range(0, rows, 1, 8).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), (F.floor(F.col("id") / 2) * 7919 % 70_001).cast("double").alias("v"))
    out = stats.worst_tail_mean(df, ["k"], "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = np.sort(np.arange(rows // 2, dtype=np.int64) * 7919 % 70_001)[:rows // 200].mean()
    got = {r["k"]: (r["n_tail"], r["worst_tail_mean"]) for r in out.collect()}
    assert set(got) == {"a", None}
    for n, mean in got.values():
        assert n == rows // 200 and abs(mean - want) < 1e-6
