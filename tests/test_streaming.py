"""Streams over files equal the batch operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.series import index_rows, time_bucket
from marketspark.operators import drawdown, stats
from marketspark.sources import files
from marketspark.streaming import jobs
from test_domain import equity_frame


def drain(stream, path, mode="append"):
    def keep(batch, i):
        batch.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{path}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/chk").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def source(spark, pdf, path, parts=3):
    df = spark.createDataFrame(pdf)
    size = len(pdf) // parts + 1
    for i in range(parts):
        spark.createDataFrame(pdf.iloc[i * size:(i + 1) * size]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_equity_controller_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    pdf = equity_frame(300)
    stream = jobs.stream_equity_states(source(spark, pdf[["account", "ts", "equity", "reset"]], str(tmp_path)))
    got = drain(stream, str(tmp_path)).toPandas().sort_values("ts")
    want = drawdown.equity_states(spark.createDataFrame(pdf)).toPandas().sort_values("pos")
    for a, b in (("current_drawdown", "current_drawdown"), ("max_drawdown", "max_drawdown")):
        assert abs(got[a].to_numpy() - want[b].to_numpy()).max() < 1e-12
    assert list(got["kill_switch"]) == list(want["emergency"])
    for m in drawdown.MODEL_LEVELS:
        assert list(got[f"{m}_state"]) == list(want[f"{m}_state"])


def test_equity_controller_orders_nan_as_sql(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    pdf = equity_frame(60)
    pdf.loc[40:44, "equity"] = float("inf")  # the drawdown is NaN from here on, which SQL orders above every number
    stream = jobs.stream_equity_states(source(spark, pdf[["account", "ts", "equity"]].assign(reset=False), str(tmp_path)))
    got = drain(stream, str(tmp_path)).orderBy("ts").collect()
    nan = float("nan")
    for r in got[40:]:
        assert repr((r["current_drawdown"], r["max_drawdown"], r["worst_since_recovery"])) == repr((nan, nan, nan)) and r["kill_switch"]
        assert {r[f"{m}_state"] for m in drawdown.MODEL_LEVELS} == {"disabled"} and r["peak_equity"] == float("inf")
    assert all(r["current_drawdown"] == r["current_drawdown"] for r in got[:40])


def test_recent_pnl_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    pdf = equity_frame(400)[["ts"]].assign(model="m", pnl=lambda d: pd.Series(range(400)).mod(7) - 3.0)
    got = drain(jobs.stream_pnl_statistics(source(spark, pdf, str(tmp_path)), keep=100), str(tmp_path), "update").toPandas()
    last = got.sort_values("_batch").iloc[-1]
    tail = stats.recent_tail_risk(spark.createDataFrame(pdf), ["model"], "pnl", ["ts"], window=100).first()
    assert last["n"] == 100
    assert abs(last["var"] - tail["var"]) < 1e-12 and abs(last["cvar"] - tail["cvar"]) < 1e-12


def test_tick_files_stream(spark, tmp_path):
    base = str(tmp_path / "ticks")
    df = spark.range(200).select("id", (F.rand(1) + 1).alias("price"), F.lit(1.0).alias("qty"), F.lit(1.0).alias("base_qty"), (F.lit(1_704_067_200_000) + F.col("id") * 60_000).alias("time"), (F.col("id") % 2 == 0).alias("is_buyer_maker"))
    df.coalesce(1).write.csv(base, header=True)
    s = files.scan_ticks(spark, base, streaming=True, files_per_trigger=1)
    out = drain(jobs.stream_bars(s, "1h", "1 minute"), str(tmp_path / "b")).toPandas()
    assert len(out) == 3 and out["trades_count"].sum() == 180


def test_alert_sink_and_refresh(spark, tmp_path):
    n = 120
    pdf = pd.DataFrame({"model": "m", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), unit="min"), "risk_score": [0.1] * 100 + [0.95] * 20, "latency_ms": 10.0, "confidence": 0.9})
    sink = jobs.alert_sink(str(tmp_path / "t"), str(tmp_path / "a"))
    src = source(spark, pdf, str(tmp_path / "s"))
    src.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    kinds = {r["alert"] for r in spark.read.json(str(tmp_path / "a")).select("alert").distinct().collect()}
    assert kinds == {"HIGH_RISK", "SIGNAL_DEGRADATION"}
    seen = []
    src = source(spark, pdf, str(tmp_path / "s2"))
    jobs.refresh(src, lambda d: index_rows(d, ["model"], ["ts"], time_bucket("ts", 3600)), lambda d: seen.append(d.count()), str(tmp_path / "c2"), str(tmp_path / "st"), {"availableNow": True}).awaitTermination()
    assert seen[-1] == n
