"""Whole trade evaluation: admission, size and leverage per proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decide as D
from .asof import Facts, asof
from .drawdown import MODEL_LEVELS
from .stats import MODEL_LIMITS, lookup

c = F.col

#: Size multipliers per volatility regime.
VOL_SIZE = {"low": 1.2, "normal": 1.0, "high": 0.6, "extreme": 0.3}
STATE_SIZE = {"enabled": 1.0, "reduced": 0.5, "disabled": 0.0}
STATE_COLUMNS = ["equity", "current_drawdown", "risk_state", "risk_multiplier", "emergency", *[f"{m}_state" for m in MODEL_LEVELS]]


def at_state(proposals: DataFrame, states: DataFrame, keys=("account",), columns=STATE_COLUMNS, initial: float = 10_000.0) -> DataFrame:
    """Latest equity-state row at or before each proposal; none yet means a fresh account."""
    out = asof(proposals, [Facts(states, columns)], keys=keys, fill=False)
    fresh = {"equity": initial, "current_drawdown": 0.0, "risk_state": "full_risk", "risk_multiplier": 1.0, "emergency": False,
             **{f"{m}_state": "enabled" for m in MODEL_LEVELS}}
    return out.withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in fresh.items() if k in columns})


def own_state() -> Column:
    """State of the proposal's own model; an unknown model counts as disabled."""
    out = None
    for m in MODEL_LEVELS:
        out = F.when(c("model") == m, c(f"{m}_state")) if out is None else out.when(c("model") == m, c(f"{m}_state"))
    return out.otherwise(F.lit("disabled"))


def admission(df: DataFrame) -> DataFrame:
    """Drawdown admission with reason, and the size factor it implies."""
    closing = (c("direction") == "close") | (c("expected_return") < 0)
    df = df.withColumn("model_state", own_state())
    allowed = F.when(c("emergency"), False).when(c("risk_state") == "risk_off", closing).when(c("model_state") == "disabled", False).otherwise(True)
    why = (F.when(c("emergency"), "emergency stop").when((c("risk_state") == "risk_off") & ~closing, "risk-off").when(c("risk_state") == "risk_off", "risk-off trade allowed")
           .when(c("model_state") == "disabled", "model disabled").when(c("model_state") == "reduced", "size limited").otherwise("allowed"))
    return df.withColumns({"dd_allowed": allowed, "dd_reason": why,
                           "dd_factor": lookup(c("model_state"), STATE_SIZE, 0.0) * c("risk_multiplier")})


def evaluate(proposals: DataFrame, states: DataFrame, tails: DataFrame, keys=("account",)) -> DataFrame:
    """Nine ordered checks of the first engine.

    ``proposals``: account, ts, model, direction, probability, confidence, expected_return, proposed_size,
    stop_loss, take_profit, volatility_regime, current_volatility.  ``tails``: per model the output of
    ``recent_tail_risk`` (one row per model).
    """
    df = admission(at_state(proposals, states, keys))
    df = df.join(tails.select("model", "cvar", "stress_cvar", c("risk_level").alias("cvar_level"), "n_samples"), "model", "left")
    enough = F.coalesce(c("n_samples") >= 30, F.lit(False))
    df = df.withColumn("cvar_reason", F.when(enough, D.cvar_admission(c("cvar"), c("stress_cvar"), c("expected_return"), lookup(c("model"), MODEL_LIMITS, 0.08))))
    df = df.withColumns({"win_rate": c("probability"), "payoff_ratio": F.when(c("stop_loss") > 0, F.try_divide(c("take_profit"), c("stop_loss"))).otherwise(1.5), "capital": c("equity")})
    df = D.kelly(df)
    df = df.withColumn("dd_size", c("final_size") * c("dd_factor"))
    df = df.withColumn("_size", c("dd_size") * lookup(c("volatility_regime"), VOL_SIZE, 1.0))
    cap = lookup(c("model"), D.MODEL_LEVERAGE, D.KELLY["max_leverage"])
    df = df.withColumn("_size", F.least(c("_size"), cap * c("equity")))
    ok = F.when(c("emergency"), "kill switch").when(~c("dd_allowed"), c("dd_reason")).when(c("cvar_reason").isNotNull(), c("cvar_reason")).when(
        c("final_size") == 0, "no kelly size").when(c("dd_size") == 0, "drawdown size zero")
    df = df.withColumn("reject_reason", ok)
    good = c("reject_reason").isNull()
    full = c("_size") >= c("proposed_size") * 0.9
    notes = D.reasons(
        F.when(enough & c("cvar_level").isin("high", "extreme"), "High CVaR - consider reduced size"), F.when(~enough, "Insufficient data for CVaR - using conservative sizing"),
        F.when(c("volatility_regime") == "high", "High volatility - size reduced"))
    return df.withColumns({
        "decision": F.when(~good, "rejected").when(full, "approved").otherwise("size_reduced"),
        "approved_size": F.when(good, c("_size")).otherwise(0.0), "adjusted_leverage": F.when(good, F.try_divide(c("_size"), c("equity"))).otherwise(0.0),
        "notes": F.when(good, notes).otherwise("Trade rejected - see reason")}).drop("_size")


#: Fixed values of the second engine.
ENGINE = {"max_leverage": 10.0, "max_position": 0.25, "cvar_max": 0.03}
ENGINE_VOL = {"low": 1.0, "medium": 0.8, "high": 0.5, "extreme": 0.2}
ENGINE_COLUMNS = ["current_drawdown", "engine_state", "dd_multiplier", "scalp_disabled", "intraday_disabled", "swing_disabled"]


#: Fixed value: the reason of a veto by the kill switch.
HALTED = "Kill switch active - all trading halted"


def evaluate_signals(signals: DataFrame, states: DataFrame, payoff: DataFrame, portfolio_cvar: DataFrame, keys=("account",), halted: str | None = None) -> DataFrame:
    """Second engine: kill switch, veto, off, tail check, Kelly chain, drawdown multiplier, leverage.

    ``payoff``: n, win_rate, payoff_ratio per model.  ``portfolio_cvar``: one row with ``cvar`` (of several the largest
    counts).  ``halted``: a boolean column of the signals that tells when the kill switch is on.
    """
    df = asof(signals, [Facts(states, ENGINE_COLUMNS)], keys=keys, fill=False)
    df = df.withColumns({"current_drawdown": F.coalesce("current_drawdown", F.lit(0.0)), "engine_state": F.coalesce("engine_state", F.lit("ON")),
                         "dd_multiplier": F.coalesce("dd_multiplier", F.lit(1.0)),
                         **{k: F.coalesce(k, F.lit(False)) for k in ENGINE_COLUMNS if k.endswith("disabled")}})
    df = df.join(payoff.select("model", c("n_trades").alias("_n"), c("win_rate").alias("_w"), c("payoff_ratio").alias("_p")), "model", "left")
    one = portfolio_cvar.agg(F.max(F.abs("cvar")).alias("current_cvar")).withColumn("_one", F.lit(1))  # one row, whatever is given
    df = df.join(F.broadcast(one), F.lit(1) == c("_one")).drop("_one")
    many = F.coalesce(c("_n") > 10, F.lit(False))
    df = df.withColumns({
        "win_rate": F.when(many, c("_w")).otherwise(0.5), "payoff_ratio": F.when(many, c("_p")).otherwise(1.0),
        "cvar_utilization": c("current_cvar") / ENGINE["cvar_max"], "impact": F.abs("expected_return") * (1 - c("confidence")) * 0.1})
    df = D.kelly_chain(df)
    disabled = F.when(c("model") == "scalp", c("scalp_disabled")).when(c("model") == "intraday", c("intraday_disabled")).otherwise(c("swing_disabled"))
    off = F.coalesce(c(halted), F.lit(False)) if halted else F.lit(False)
    tail = D.engine_admission(c("impact"), c("current_cvar"), ENGINE["cvar_max"])
    size = F.least(c("kelly") * c("dd_multiplier"), F.lit(ENGINE["max_position"]))
    lev = F.least(ENGINE["max_leverage"] * c("confidence") * lookup(c("volatility_regime"), ENGINE_VOL, 0.5) * c("dd_multiplier"), F.lit(ENGINE["max_leverage"]))
    df = df.withColumns({"_size": size, "_lev": lev, "block_reason": F.when(off, HALTED).when(disabled, "model disabled").when(c("engine_state") == "OFF", "risk off").when(tail.isNotNull(), tail)})
    free = c("block_reason").isNull()
    decision = (F.when(off | disabled, "vetoed").when(~free, "rejected").when(c("_size") < 0.001, "rejected").when(c("_size") < c("kelly") * 0.5, "reduced").otherwise("approved"))
    return df.withColumns({"decision": decision, "approved_size": F.when(free, c("_size")).otherwise(0.0), "approved_leverage": F.when(free, c("_lev")).otherwise(0.0)}
                          ).drop("_size", "_lev", "_n", "_w", "_p")


def decision_counters(decisions: DataFrame, keys=("account",)) -> DataFrame:
    ok = c("decision").isin("approved", "reduced", "size_reduced")
    g = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_decisions"), F.count_if(ok).alias("approved"), F.count_if(~ok).alias("rejected"))
    return g.withColumn("approval_rate", c("approved") / F.greatest(c("total_decisions"), F.lit(1)))


def status_snapshot(states: DataFrame, tails: DataFrame, payoff: DataFrame, keys=("account",), pos: str = "pos") -> DataFrame:
    """Latest state per account and model with tail and payoff figures."""
    last = states.groupBy(*keys).agg(F.max_by(F.struct("equity", "risk_state", "current_drawdown", "max_drawdown", "risk_multiplier", "emergency",
                                                       *[f"{m}_state" for m in MODEL_LEVELS]), pos).alias("s"))
    n_on = sum(((c(f"s.{m}_state") == "enabled").cast("int") for m in MODEL_LEVELS), F.lit(0))
    item = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c(f"s.{m}_state").alias("state")) for m in MODEL_LEVELS]))
    rows = last.select(*keys, c("s.risk_state").alias("risk_state"), c("s.emergency").alias("kill_switch"), c("s.equity").alias("equity"), c("s.current_drawdown").alias("current_drawdown"),
                       c("s.max_drawdown").alias("max_drawdown"), c("s.risk_multiplier").alias("risk_multiplier"), n_on.alias("models_enabled"), item.alias("m"))
    rows = rows.select("*", "m.model", "m.state").drop("m").join(tails.select("model", "cvar", "risk_level", "n_samples"), "model", "left")
    rows = rows.join(payoff.select("model", "win_rate", "payoff_ratio", "n_trades"), "model", "left")
    few = F.coalesce(c("n_samples") < 30, F.lit(True))
    return rows.withColumns({
        "cvar": F.when(few, lookup(c("model"), MODEL_LIMITS, 0.08)).otherwise(c("cvar")), "cvar_risk_level": F.when(few, "high").otherwise(c("risk_level")),
        "win_rate": F.coalesce("win_rate", F.lit(0.5)), "payoff_ratio": F.coalesce("payoff_ratio", F.lit(1.0)), "n_trades": F.coalesce("n_trades", F.lit(0)),
        "is_enabled": c("state") == "enabled", "is_reduced": c("state") == "reduced"}).drop("n_samples", "risk_level")


def proposal_features(df: DataFrame) -> DataFrame:
    """Proposal as model inputs."""
    hot = {f"is_{m}": (c("model") == m) for m in MODEL_LEVELS} | {"is_long": c("direction") == "long"} | {f"vol_{v}": c("volatility_regime") == v for v in ("low", "normal", "high")}
    return df.withColumns({k: F.coalesce(v, F.lit(False)).cast("double") for k, v in hot.items()})
