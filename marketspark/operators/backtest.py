"""Bracket outcomes of signals over bars, cost model, trade tables and robustness runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import hashed_normal, index_rows, Pieces, running, time_bucket
from ..session import materialize, ship
from .stats import trade_metrics

c = F.col

#: Fixed values.
COMMISSION, SLIPPAGE, CAPITAL = 0.001, 0.0005, 10_000.0
#: Children per block of the price-range index.
FANOUT = 64


def signals_on_bars(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals at a bar time with that bar's prices."""
    return signals.join(bars.select("symbol", "ts", "pos", "open", "high", "low", "close"), ["symbol", "ts"])


def at_times(df: DataFrame, times: DataFrame) -> DataFrame:
    """Rows whose time is in a set of times."""
    return df.join(times.select("ts").distinct(), "ts", "left_semi")


def levels_for(bars: DataFrame) -> int:
    """Levels needed for the longest series; one number comes to the driver."""
    longest = (bars.agg(F.max("pos")).first()[0] or 0) + 1
    levels = 1
    while FANOUT**levels < longest:
        levels += 1
    return levels


def range_index(bars: DataFrame, levels: int) -> list[DataFrame]:
    """Per level: ``(symbol, _parent, kids)``; ``kids`` holds the low/high of up to 64 children.

    Level 0 children are bars; a child of level k covers 64**k bars.
    """
    blocks = bars.select("symbol", c("pos").alias("_id"), "low", "high")
    out = []
    for _ in range(levels):
        blocks = blocks.withColumn("_parent", F.floor(c("_id") / FANOUT))
        kids = F.array_sort(F.collect_list(F.struct(c("_id").alias("i"), c("low").alias("lo"), c("high").alias("hi"))))
        out.append(blocks.groupBy("symbol", "_parent").agg(kids.alias("kids")))
        blocks = blocks.groupBy("symbol", c("_parent").alias("_id")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out


def bracket_outcomes(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """First later bar that touches the stop or the target of each signal.

    ``signals``: symbol, pos, direction, sl, tp and anything else.  The search climbs a 64-way index of
    price ranges and descends to the bar, so a signal meets at most 64 entries per level however far its
    exit lies.  Stop wins over target on one bar; untouched signals close at the last close (``timeout``).
    """
    hit = lambda k: F.when(c("direction") == "LONG", (k["lo"] <= c("sl")) | (k["hi"] >= c("tp"))).otherwise(
        (k["hi"] >= c("sl")) | (k["lo"] <= c("tp")))
    levels = levels_for(bars)
    index = range_index(bars, levels)
    df = signals.withColumns({"_from": c("pos"), "_found": F.lit(None).cast("long"), "_level": F.lit(None).cast("int")})
    for level, table in enumerate(index):
        # blocks after the signal's own one inside the parent; found at an earlier level: skip
        df = df.withColumn("_parent", F.floor(c("_from") / FANOUT)).join(table, ["symbol", "_parent"], "left")
        first = F.get(F.filter(c("kids"), lambda k: (k["i"] > c("_from")) & hit(k)), F.lit(0))["i"]
        df = df.withColumn("_new", F.when(c("_found").isNull(), first))
        df = df.withColumns({"_level": F.when(c("_new").isNotNull(), F.lit(level)).otherwise(c("_level")), "_found": F.coalesce("_found", "_new"),
                             "_from": c("_parent")}).drop("_parent", "kids", "_new")
    for level in range(levels - 1, 0, -1):
        # descend: the found block is the parent of its children
        df = df.withColumn("_parent", F.when(c("_level") == level, c("_found"))).join(index[level - 1], ["symbol", "_parent"], "left")
        first = F.get(F.filter(c("kids"), lambda k: hit(k)), F.lit(0))["i"]
        here = c("_level") == level
        df = df.withColumns({"_found": F.when(here, first).otherwise(c("_found")), "_level": F.when(here, F.lit(level - 1)).otherwise(c("_level"))}).drop("_parent", "kids")
    ends = bars.groupBy("symbol").agg(F.max_by(F.struct("pos", "ts", "close"), "pos").alias("_end"))
    exits = bars.select("symbol", c("pos").alias("_found"), c("ts").alias("_xts"), c("low").alias("_xlo"), c("high").alias("_xhi"))
    df = df.join(exits, ["symbol", "_found"], "left").join(ends, "symbol", "left")
    long = c("direction") == "LONG"
    stopped = F.when(long, c("_xlo") <= c("sl")).otherwise(c("_xhi") >= c("sl"))
    reason = F.when(c("_found").isNull(), "timeout").when(stopped, "sl").otherwise("tp")
    return df.withColumns({
        "exit_reason": reason, "exit_pos": F.coalesce("_found", c("_end.pos")), "exit_ts": F.coalesce("_xts", c("_end.ts")),
        "raw_exit": F.when(c("_found").isNull(), c("_end.close")).when(stopped, c("sl")).otherwise(c("tp")),
    }).drop("_found", "_level", "_from", "_xts", "_xlo", "_xhi", "_end")


def _chain(pos: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next taken signal of each signal inside its piece (the piece's length: none), and the exit of the last one of its chain."""
    n = len(pos)
    nxt = np.searchsorted(pos, exits, side="left")
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:  # pointer doubling: every pointer jumps twice as far each time
        far = last[last]
        if (far == last).all():
            return nxt, exits[last]
        last = far


def _reached(nxt: np.ndarray, start: int) -> np.ndarray:
    """All signals of the chain that begins at ``start``."""
    jump, jumps = np.append(nxt, len(nxt)), []
    while (jump < len(nxt)).any():
        jumps.append(jump)
        jump = jump[jump]
    found = np.array([start])
    for jump in jumps[::-1]:
        found = np.concatenate((found, jump[found]))
        found = found[found < len(nxt)]
    return found


def one_position(outcomes: DataFrame, rows: int = 65_536, order: Sequence[str] = ("pos", "direction")) -> DataFrame:
    """Keep only signals that find no open position of their symbol.

    A signal is taken when its bar is at or after the exit of the last taken one.  Signals are cut
    into bounded pieces.  A piece is a function from the position at which its symbol becomes free
    to the one at which it is free again after the piece; only positions at which some piece is left
    are ever handed to a later piece, so these are the function's nodes.  The chain from a symbol's
    first piece on is found by pointer doubling over the nodes: each round joins the pointers with
    themselves and doubles the part of the chain that is known, so the number of jobs grows with the
    logarithm of the number of pieces.
    """
    ship(outcomes.sparkSession)
    w = index_rows(outcomes, ["symbol"], list(order), F.floor(c("pos") / rows), pos="_idx")
    w = w.withColumn("_piece", F.floor(c("_idx") / rows).cast("long"))
    # a timeout closes after the last bar: nothing can follow it
    slim = materialize(w.select("symbol", "_piece", "_idx", "pos", F.when(c("exit_reason") == "timeout", F.lit(2**62)).otherwise(c("exit_pos")).cast("long").alias("_exit")), "signals")
    pieces = slim.groupBy("symbol", "_piece").agg(F.max("pos").alias("_at"))
    nodes = slim.select("symbol").distinct().select("symbol", F.lit(0).cast("long").alias("_piece"), F.lit(-1).cast("long").alias("_start"))
    reached = nodes

    def free_at(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        _, free = _chain(pdf["pos"].to_numpy(), pdf["_exit"].to_numpy())
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "_piece": pdf["_piece"].iloc[0], "_free": np.unique(free[free < 2**62])})

    def leave(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        _, free = _chain(pdf["pos"].to_numpy(), pdf["_exit"].to_numpy())
        return starts.assign(_free=free[np.searchsorted(pdf["pos"].to_numpy(), starts["_start"].to_numpy(), side="left")]) if len(pdf) else starts.assign(_free=0).iloc[:0]

    def mark(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(starts):
            return pdf.iloc[:0][["symbol", "_piece", "_idx"]]
        pdf = pdf.sort_values("_idx")
        pos = pdf["pos"].to_numpy()
        nxt, _ = _chain(pos, pdf["_exit"].to_numpy())
        return pdf.iloc[np.sort(_reached(nxt, int(np.searchsorted(pos, starts["_start"].iloc[0], side="left"))))][["symbol", "_piece", "_idx"]]

    together = lambda other: slim.groupBy("symbol", "_piece").cogroup(other.groupBy("symbol", "_piece"))
    last = pieces.agg(F.max("_piece")).first()[0] or 0
    if last:
        exits = slim.groupBy("symbol", "_piece").applyInPandas(free_at, "symbol string, _piece long, _free long")
        # where each exit goes on: the first piece that still has a signal at or after it
        both = exits.select("symbol", (-c("_free")).alias("_neg"), F.lit(1).alias("_kind"), "_piece", "_free").unionByName(
            pieces.select("symbol", (-c("_at")).alias("_neg"), F.lit(0).alias("_kind"), "_piece", F.lit(None).cast("long").alias("_free")))
        both = running(both, ["symbol"], ["_neg", "_kind"], F.floor(c("_neg") / rows), {"_to": ("min", F.when(c("_kind") == 0, c("_piece")))})
        to = materialize(both.filter("_kind = 1 AND _to IS NOT NULL").select("symbol", "_piece", "_free", "_to"), "exits")
        nodes = nodes.unionByName(to.select("symbol", c("_to").alias("_piece"), c("_free").alias("_start")).distinct())
        jump = together(nodes).applyInPandas(leave, "symbol string, _piece long, _start long, _free long")
        jump = materialize(jump.join(to, ["symbol", "_piece", "_free"]).select("symbol", "_piece", "_start", c("_to").alias("_p"), c("_free").alias("_s")), "jumps")
        while True:
            more = materialize(reached.join(jump, ["symbol", "_piece", "_start"]).select("symbol", c("_p").alias("_piece"), c("_s").alias("_start")), "reached")
            if more.isEmpty():
                break
            reached = reached.unionByName(more)
            on = jump.select("symbol", c("_piece").alias("_p"), c("_start").alias("_s"), c("_p").alias("_p2"), c("_s").alias("_s2"))
            jump = materialize(jump.join(on, ["symbol", "_p", "_s"]).select("symbol", "_piece", "_start", c("_p2").alias("_p"), c("_s2").alias("_s")), "jumps")
    taken = together(reached).applyInPandas(mark, "symbol string, _piece long, _idx long")
    return w.join(taken, ["symbol", "_piece", "_idx"], "left_semi").drop("_piece", "_idx")


def trades(outcomes: DataFrame, entry: str = "entry", size_pct: float = 0.1, capital: float = CAPITAL) -> DataFrame:
    """Costed trades: slippage against the trader on both sides, commission on both notionals once."""
    long = c("direction") == "LONG"
    slip = lambda p, up: F.when(up, p * (1 + SLIPPAGE)).otherwise(p * (1 - SLIPPAGE))
    df = outcomes.withColumns({"entry_price": slip(c(entry), long), "exit_price": slip(c("raw_exit"), ~long), "size": F.lit(capital * size_pct) / c(entry)})
    gross = F.when(long, c("exit_price") - c("entry_price")).otherwise(c("entry_price") - c("exit_price")) * c("size")
    df = df.withColumn("commission", (c("entry_price") + c("exit_price")) * c("size") * COMMISSION)
    df = df.withColumn("pnl", gross - c("commission"))
    return df.withColumn("pnl_pct", c("pnl") / (c("entry_price") * c("size")))


def summary(tr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return trade_metrics(tr, keys, "pnl", "ts", "exit_ts")


def time_blocks(bars: DataFrame, blocks: int, share: float) -> DataFrame:
    """Distinct bar times with block number and test flag: equal blocks, the last part of each is test."""
    times = index_rows(bars.select("ts").distinct(), (), ["ts"], time_bucket("ts", 30 * 86_400), pos="k", total="m")
    width = F.floor(c("m") / blocks)
    t = times.withColumn("block", F.floor(c("k") / width)).filter(c("block") < blocks)
    inside = c("k") - c("block") * width
    return t.withColumn("is_test", inside >= F.floor(width * share)).select("ts", "block", "is_test")


def _run(signals: DataFrame, bars: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Backtest within each tag value: bars are re-indexed inside it."""
    key = F.concat_ws("|", "symbol", *[c(t).cast("string") for t in tags])
    b = bars.withColumn("symbol", key).drop("pos", "n")
    b = materialize(index_rows(b, ["symbol"], ["ts"], time_bucket("ts", 30 * 86_400)), "bars")
    s = signals.withColumn("symbol", key).drop("pos").join(b.select("symbol", "ts", "pos"), ["symbol", "ts"])
    return summary(trades(one_position(materialize(bracket_outcomes(s, b), "outcomes"))), tags)


def walk_forward(signals: DataFrame, bars: DataFrame, blocks: int = 5, share: float = 0.7) -> DataFrame:
    t = time_blocks(bars, blocks, share).filter("is_test").drop("is_test")
    return _run(signals.join(t, "ts"), bars.join(t, "ts"), ["block"])


def in_and_out_of_sample(signals: DataFrame, bars: DataFrame, share: float = 0.8) -> DataFrame:
    t = time_blocks(bars, 1, share).select("ts", F.when(c("is_test"), "out_of_sample").otherwise("in_sample").alias("sample"))
    return _run(signals.join(t, "ts"), bars.join(t, "ts"), ["sample"])


def noise_runs(signals: DataFrame, bars: DataFrame, levels: Sequence[float] = (0.001, 0.002, 0.005), iterations: int = 10, seed: int = 42) -> DataFrame:
    """The backtest on prices multiplied by 1 + N(0, sigma), for every level and iteration."""
    runs = F.explode(F.array(*[F.struct(F.lit(s).alias("sigma"), F.lit(i).alias("iteration")) for s in levels for i in range(iterations)]))
    spread = lambda df: df.withColumn("_r", runs).select("*", "_r.sigma", "_r.iteration").drop("_r")
    noisy = spread(bars).withColumns({p: c(p) * (1 + c("sigma") * hashed_normal(seed + i, "symbol", "ts", "sigma", "iteration")) for i, p in enumerate(("open", "high", "low", "close"))})
    return _run(spread(signals), noisy, ["sigma", "iteration"])


def with_regime(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """bull / bear / flat from the 20-bar return, +-5 %."""
    s = Pieces(bars, halo=32, rows=rows)
    s.stage(_r20=s.pct("close", 20))
    return s.stage(regime=F.when(c("_r20") > 0.05, "bull").when(c("_r20") < -0.05, "bear").otherwise("flat")).close()


def by_regime(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Backtest on the bars of each regime; signals take part at any time a symbol is in the regime."""
    b = with_regime(bars)
    times = b.select("regime", "ts").distinct()
    return _run(signals.join(times, "ts"), b, ["regime"])


def equity_curve(tr: DataFrame, keys: Sequence[str] = (), capital: float = CAPITAL) -> DataFrame:
    """Closed-trade equity in exit order."""
    t = index_rows(tr, keys, ["exit_ts", "symbol", "ts"], time_bucket("exit_ts", 7 * 86_400))
    t = running(t, keys, ["pos"], F.floor(c("pos") / 32_768), {"_cum": ("sum", c("pnl"))})
    return t.withColumn("equity", capital + c("_cum")).drop("_cum")


