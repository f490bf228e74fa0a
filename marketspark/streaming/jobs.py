"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.series import flag
from ..operators import stats
from ..operators.bars import WEEK_SHIFT, bar_columns, bin_label, width_of
from ..session import ship
from ..operators.drawdown import EMERGENCY, MODEL_LEVELS, RECOVERY, multiplier, risk_state

c = F.col


def stream_bars(ticks: DataFrame, timeframe: str, late: str = "10 minutes", anchor_day: int | None = None) -> DataFrame:
    """Continuous bars in append mode, labelled like the batch form; ticks later than the watermark are dropped.

    Three-day bars count from a first day, which a stream cannot know: ``anchor_day`` is its epoch second.
    """
    if timeframe == "3d" and anchor_day is None:
        raise ValueError("three-day bars of a stream need the first day")
    width = width_of(timeframe)
    start = WEEK_SHIFT if timeframe == "1w" else anchor_day % width if timeframe == "3d" else 0
    w = F.window("ts", f"{width} seconds", startTime=f"{start} seconds")
    out = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(*bar_columns())
    return out.select("symbol", bin_label(F.unix_seconds(c("w.start")), timeframe).alias("ts"), "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "trades_count")


def sliding_statistics(ticks: DataFrame, length: str = "20 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Deviation, mean, volume and worst move over sliding time windows."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, slide).alias("w"))
    g = g.agg(F.count("price").alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.sum("qty").alias("volume"), F.min("price").alias("low"))
    return g.select("symbol", c("w.start").alias("ts"), "n", "mean", "std", "volume", "low")


#: Rows that leave the controller at once.
CHUNK = 10_000
#: Stands for NaN inside the controller and in its rows, since pandas cannot tell NaN from null.
INFINITE = float("inf")
STATE = T.StructType([T.StructField("peak", T.DoubleType()), T.StructField("worst", T.DoubleType()), T.StructField("latched", T.BooleanType()), T.StructField("since", T.DoubleType())])
OUTPUT = T.StructType([
    T.StructField("account", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("equity", T.DoubleType()),
    T.StructField("peak_equity", T.DoubleType()), T.StructField("current_drawdown", T.DoubleType()), T.StructField("max_drawdown", T.DoubleType()),
    T.StructField("worst_since_recovery", T.DoubleType()), T.StructField("kill_switch", T.BooleanType()),
])


class EquityController(StatefulProcessor):
    """Peak, drawdown and latch per account; a reset event starts afresh."""

    def __init__(self, initial: float = 10_000.0):
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("controller", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peak, worst, latched, since = self.state.get() if self.state.exists() else (self.initial, 0.0, False, 0.0)
        # three columns of one account's part of a micro-batch, which the source's trigger options bound
        held = pd.concat([part[["ts", "equity", "reset"]] for part in rows]).sort_values("ts", kind="stable")
        for lo in range(0, len(held), CHUNK):
            out = []
            for ts, equity, reset in held.iloc[lo:lo + CHUNK].itertuples(index=False):
                if reset:
                    peak, worst, latched, since = equity, 0.0, False, 0.0
                peak = max(peak, equity)
                dd = (peak - equity) / peak if peak > 0 else 0.0
                if dd != dd:  # infinite equity: SQL orders NaN above every number, and so does infinity here
                    dd = INFINITE
                worst = max(worst, dd)
                since = dd if dd < RECOVERY else max(since, dd)
                latched = latched or dd >= EMERGENCY
                out.append((key[0], ts, equity, peak, dd, worst, since, latched))
            yield pd.DataFrame(out, columns=OUTPUT.names)
        self.state.update((float(peak), float(worst), bool(latched), float(since)))

    def close(self) -> None:
        pass


def stream_equity_states(equity: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """Stateful controller over ``(account, ts, equity, reset)`` with the derived states.

    The store provider must be RocksDB.
    """
    ship(equity.sparkSession)
    df = equity.groupBy("account").transformWithStateInPandas(EquityController(initial), OUTPUT, "Append", "None")
    df = df.withColumns({n: F.when(c(n) == INFINITE, F.lit(float("nan"))).otherwise(c(n)) for n in ("current_drawdown", "max_drawdown", "worst_since_recovery")})
    dd, worst = c("current_drawdown"), c("worst_since_recovery")
    models = {f"{m}_state": F.when(worst >= off, "disabled").when(worst >= low, "reduced").otherwise("enabled") for m, (low, off) in MODEL_LEVELS.items()}
    return df.withColumns({"risk_state": risk_state(dd), "risk_multiplier": multiplier(dd), **models})


class RecentPnl(StatefulProcessor):
    """The last N results per model, with their payoff and tail figures after every batch."""

    def __init__(self, keep: int = 252):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("pnl", T.StructType([T.StructField("pnl", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        for part in rows:  # no more than the last N of a batch are ever held
            part = part[["ts", "pnl"]]
            held = (part if held is None else pd.concat((held, part))).sort_values("ts", kind="stable").iloc[-self.keep:]
        new = held["pnl"].tolist()
        old = [r[0] for r in self.history.get()] if self.history.exists() else []
        kept = (old + new)[-self.keep:]
        self.history.put([(float(x),) for x in kept])
        s = pd.Series(kept)
        wins, losses = s[s > 0], s[s < 0]
        var = float((-s).quantile(0.95))
        yield pd.DataFrame([(key[0], len(s), len(wins) / len(s), float(wins.mean()) if len(wins) else 0.01,
                             float(-losses.mean()) if len(losses) else 0.01, var, float((-s)[-s >= var].mean()))],
                           columns=["model", "n", "win_rate", "avg_win", "avg_loss", "var", "cvar"])

    def close(self) -> None:
        pass


PNL_OUTPUT = "model string, n long, win_rate double, avg_win double, avg_loss double, var double, cvar double"


def stream_pnl_statistics(pnl: DataFrame, keep: int = 252) -> DataFrame:
    ship(pnl.sparkSession)
    return pnl.groupBy("model").transformWithStateInPandas(RecentPnl(keep), PNL_OUTPUT, "Update", "None")


class RecentScores(StatefulProcessor):
    """The last scores per model and, after every batch, the drift of the newest against those before them."""

    def __init__(self, recent: int = 20, before: int = 30, limit: float = 0.9):
        self.recent, self.keep, self.limit = recent, recent + before, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", T.StructType([T.StructField("at", T.LongType()), T.StructField("score", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.scores.get()) if self.scores.exists() else [], columns=["at", "score"])
        for part in rows:  # no more than the last ones are ever held
            new = pd.DataFrame({"at": part["ts"].astype("datetime64[us]").astype("int64"), "score": part["risk_score"].astype(float)})
            held = (pd.concat((held, new)) if len(held) else new).sort_values("at", kind="stable").iloc[-self.keep:]
        self.scores.put([(int(a), float(x)) for a, x in held.itertuples(index=False)])
        if len(held) >= self.keep:
            old, new = held["score"].iloc[:-self.recent], held["score"].iloc[-self.recent:]
            drift = abs(new.mean() - old.mean()) / (old.std(ddof=0) + 0.01)
            yield pd.DataFrame([(key[0], len(held), float(drift), bool(drift > self.limit))], columns=["model", "n", "drift", "alert"])

    def close(self) -> None:
        pass


def stream_degradation(scores: DataFrame) -> DataFrame:
    """``degradation`` as a stream: model, n, drift and alert after every batch that brings a model scores.

    The last fifty scores of a model are keyed state, so a batch costs its own rows and a lost batch loses no history.
    """
    ship(scores.sparkSession)
    return scores.groupBy("model").transformWithStateInPandas(RecentScores(), "model string, n long, drift double, alert boolean", "Update", "None")


def degradation(scores: DataFrame, value: str = "risk_score", order: str = "ts", keys=("model",)) -> DataFrame:
    """Drift of the last 20 scores against the 30 before them, per key; over .9 alerts."""
    t = stats.last_rows(scores, keys, [order], 50)
    recent, before = c("_rank") <= 20, c("_rank") > 20
    g = t.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(F.when(recent, c(value))).alias("_a"), F.avg(F.when(before, c(value))).alias("_b"), F.stddev_pop(F.when(before, c(value))).alias("_s"))
    g = g.withColumn("drift", F.abs(c("_a") - c("_b")) / (c("_s") + 0.01)).filter("n >= 50")
    return g.withColumn("alert", c("drift") > 0.9).drop("_a", "_b", "_s")


def alerts(scores: DataFrame, max_latency_ms: float = 100.0) -> DataFrame:
    """Row alerts: slow answers, low confidence, blocked trades."""
    kinds = F.array_compact(F.array(F.when(c("latency_ms") > max_latency_ms, F.lit("HIGH_LATENCY")), F.when(c("confidence") < 0.3, F.lit("LOW_CONFIDENCE")),
                                    F.when(flag(c("risk_score") > 0.9) == 1, F.lit("HIGH_RISK"))))
    return scores.withColumn("alert", F.explode(kinds))


def _stored_batch(spark, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/batch={batch_id}")
    except AnalysisException:
        return None


def alert_sink(table_path: str, alert_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: retain the scores, write row alerts and drift alerts as JSON.

    Every batch overwrites its own folder, so a batch that is run again changes nothing. Drift needs the last 50 scores of a
    model: each batch writes them beside the table and the next one starts from there, whatever the table has grown to.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        before = _stored_batch(spark, f"{table_path}-recent", batch_id - 1)
        held = batch if before is None else before.unionByName(batch)
        stats.last_rows(held, ["model"], ["ts"], 50).select(*batch.columns).write.mode("overwrite").parquet(f"{table_path}-recent/batch={batch_id}")
        drift = degradation(_stored_batch(spark, f"{table_path}-recent", batch_id)).filter("alert")
        found = alerts(batch).unionByName(drift.select("model", F.lit("SIGNAL_DEGRADATION").alias("alert"), F.round("drift", 4).alias("drift")), allowMissingColumns=True)
        found.write.mode("overwrite").json(f"{alert_path}/batch={batch_id}")

    return run


def append_history(predictions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Prediction rows to JSON, one folder per day, exactly once."""
    out = predictions.withColumn("date", F.to_date("ts"))
    return out.writeStream.format("json").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def refresh(bars: DataFrame, build: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None], checkpoint: str, store: str, trigger: dict | None = None):
    """Rebuild features and scores on a timer: each batch extends the stored bars, then the batch path runs."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        publish(build(batch.sparkSession.read.parquet(store).drop("batch")))

    return bars.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
