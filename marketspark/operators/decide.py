"""Row-wise decisions: votes, gates, signals, Kelly sizes, ensemble rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import index_rows, ratio
from ..session import materialize
from .stats import lookup

#: Fixed values.
WEIGHTS = {"scalp": 0.5, "intraday": 0.3, "swing": 0.2}
ENTRY_THRESHOLD, MAX_RISK = 0.35, 0.7
MAX_RISK_PER_TRADE, MAX_POSITIONS, TOP_COINS, MAX_CORRELATION, MIN_SCORE = 0.02, 5, 10, 0.7, 0.1
MISSING = {"P_up": 0.33, "P_down": 0.33, "P_flat": 0.34, "expected_return": 0.0}
MODELS = tuple(WEIGHTS)

c = F.col


def reasons(*items: Column, sep: str = "; ") -> Column:
    return F.concat_ws(sep, F.array_compact(F.array(*items)))


def assemble_predictions(symbols: DataFrame, outputs: dict[str, DataFrame], risk: DataFrame | None = None) -> DataFrame:
    """Model outputs side by side per symbol; a missing model gets neutral values, missing risk .5."""
    out = symbols
    for m in MODELS:
        if m in outputs:
            o = outputs[m].select("symbol", *[c(x).alias(f"{m}_{x}") for x in MISSING])
            out = out.join(o, "symbol", "left")
            out = out.withColumns({f"{m}_{x}": F.coalesce(c(f"{m}_{x}"), F.lit(d)) for x, d in MISSING.items()})
        else:
            out = out.withColumns({f"{m}_{x}": F.lit(d) for x, d in MISSING.items()})
    if risk is None:
        return out.withColumn("risk_score", F.lit(0.5))
    return out.join(risk.select("symbol", "risk_score"), "symbol", "left").withColumn("risk_score", F.coalesce("risk_score", F.lit(0.5)))


def _vote(field: str, default: float) -> Column:
    total = sum(WEIGHTS.values())
    return sum((F.coalesce(c(f"{m}_{field}"), F.lit(default)) * (w / total) for m, w in WEIGHTS.items()), F.lit(0.0))


def meta_decision(p: DataFrame) -> DataFrame:
    """Weighted vote, direction, dominant timeframe, gates with their reasons."""
    up, down = _vote("P_up", 0.33), _vote("P_down", 0.33)
    p = p.withColumns({"score_long": up, "score_short": down, "expected_return": _vote("expected_return", 0.0)})
    lo, sh = c("score_long"), c("score_short")
    p = p.withColumns({
        "direction": F.when(lo > sh, "LONG").when(sh > lo, "SHORT").otherwise("NEUTRAL"),
        "confidence": F.when(lo > sh, lo).when(sh > lo, sh).otherwise(0.5)})
    side = {m: F.when(c("direction") == "LONG", F.coalesce(c(f"{m}_P_up"), F.lit(0.0))).otherwise(F.coalesce(c(f"{m}_P_down"), F.lit(0.0))) for m in MODELS}
    top, low = F.greatest(*side.values()), F.least(*side.values())
    best = F.when(side["scalp"] == top, "scalp").when(side["intraday"] == top, "intraday").otherwise("swing")
    swing_up, swing_down = F.coalesce(c("swing_P_up"), F.lit(0.33)), F.coalesce(c("swing_P_down"), F.lit(0.33))
    low_conf = c("confidence") < ENTRY_THRESHOLD
    against_long = (c("direction") == "LONG") & (swing_down > 0.5)
    against_short = (c("direction") == "SHORT") & (swing_up > 0.5)
    risky, neutral = c("risk_score") > MAX_RISK, c("direction") == "NEUTRAL"
    p = p.withColumns({
        "timeframe_used": F.when(neutral, "none").when(top - low < 0.1, "multi").otherwise(best),
        "should_trade": ~(low_conf | against_long | against_short | risky | neutral)})
    why = reasons(
        F.when(low_conf, F.format_string(f"Low confidence (%.2f < {ENTRY_THRESHOLD})", c("confidence"))),
        F.when(against_long, F.format_string("Swing against LONG (P_down=%.2f)", swing_down)),
        F.when(against_short, F.format_string("Swing against SHORT (P_up=%.2f)", swing_up)),
        F.when(risky, F.format_string(f"High risk (%.2f > {MAX_RISK})", c("risk_score"))),
        F.when(neutral, "No clear direction"))
    fine = F.format_string("All conditions met. Direction: %s, Confidence: %.2f", c("direction"), c("confidence"))
    return p.withColumn("reason", F.when(c("should_trade"), fine).otherwise(why))


def class_of(up: Column, flat: Column, down: Column) -> DataFrame:
    """(predicted class, confidence, expected return); the first maximum wins in class order."""
    top = F.greatest(down, flat, up)
    return F.when(down == top, 0).when(flat == top, 1).otherwise(2), top, up - down


def live_meta(p: DataFrame) -> DataFrame:
    """Weighted P_up - P_down over the models present, with the +-.15 signal."""
    has = {m: c(f"{m}_P_up").isNotNull() & c(f"{m}_P_down").isNotNull() for m in MODELS}
    num = sum((F.when(has[m], w * (c(f"{m}_P_up") - c(f"{m}_P_down"))).otherwise(0.0) for m, w in WEIGHTS.items()), F.lit(0.0))
    den = sum((F.when(has[m], F.lit(w)).otherwise(0.0) for m, w in WEIGHTS.items()), F.lit(0.0))
    p = p.withColumn("meta_score", F.when(den > 0, ratio(num, den)).otherwise(0.0))
    return p.withColumn("meta_signal", F.when(c("meta_score") > 0.15, "LONG").when(c("meta_score") < -0.15, "SHORT").otherwise("NEUTRAL"))


def risk_bucket(df: DataFrame, raw: str = "risk_score") -> DataFrame:
    s = F.least(F.greatest(c(raw), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({
        "risk_clipped": s, "risk_level": F.when(s < 0.25, "LOW").when(s < 0.5, "MEDIUM").when(s < 0.75, "HIGH").otherwise("CRITICAL"),
        "max_leverage": F.when(s < 0.25, 10.0).when(s < 0.5, 5.0).when(s < 0.75, 2.0).otherwise(1.0)})


# ---------------------------------------------------------------- ranking and signals


def rank_candidates(decisions: DataFrame) -> DataFrame:
    """Tradable symbols by confidence * |expected return| / max(risk, .1), ranked from 1.

    The rank is global, but no task sees all rows: they are ranked inside ranges of the score, after the counts of the
    ranges before.
    """
    score = c("confidence") * F.abs("expected_return") / F.greatest(c("risk_score"), F.lit(0.1))
    d = decisions.filter("should_trade").withColumn("final_score", score).filter(c("final_score") >= MIN_SCORE)
    ranked = index_rows(d.withColumn("_falling", -c("final_score")), [], ["_falling", "symbol"], F.floor(c("_falling") * 256), pos="rank")
    return ranked.withColumn("rank", (c("rank") + 1).cast("int")).drop("_falling")


def correlation_of(r: Column, other: list[float]) -> Column:
    """Pearson correlation of a fixed-length array column with a literal array."""
    n = len(other)
    mean = sum(other) / n
    dev = [x - mean for x in other]
    ss = sum(x * x for x in dev)
    mean_r = F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / n
    cov = sum((F.get(r, F.lit(i)) * d for i, d in enumerate(dev)), F.lit(0.0))
    ss_r = F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x) - mean_r * mean_r * n
    return F.coalesce(ratio(cov, F.sqrt(F.greatest(ss_r, F.lit(0.0)) * ss)), F.lit(0.0))


def select_uncorrelated(ranked: DataFrame, returns: DataFrame | None, top: int = min(TOP_COINS, MAX_POSITIONS), limit: float = MAX_CORRELATION) -> DataFrame:
    """Walk the ranking, skipping symbols correlated with an already selected one; first ``top`` kept.

    Only the selected symbols are ever compared with the rest, so ``top`` passes of one row
    against all replace a table of pairs.  Each pass brings one bounded row to the driver.
    """
    if returns is None:
        return ranked.filter(c("rank") <= top)
    # one row per tradable symbol; written once because every pass reads it
    left = materialize(ranked.join(returns, "symbol", "left"), "ranked")
    picked: list[str] = []
    rest = left
    for _ in range(top):
        row = rest.orderBy("rank").select("symbol", "r").first()
        if row is None:
            break
        picked.append(row["symbol"])
        rest = rest.filter(c("symbol") != row["symbol"])
        if row["r"] is not None:
            rest = rest.filter(c("r").isNull() | (F.abs(correlation_of(c("r"), list(row["r"]))) <= limit))
    return (left.filter(c("symbol").isin(picked)) if picked else left.limit(0)).select(*ranked.columns)


def entry_and_targets(s: DataFrame, price: str = "price", vol: str = "volatility") -> DataFrame:
    """Entry range, stop, two targets, leverage, risk share and position size."""
    p, v, k = c(price), c(vol), c("risk_score")
    long = c("direction") == "LONG"
    s = s.withColumns({
        "entry_range_low": F.when(long, p - p * v * 0.5).otherwise(p), "entry_range_high": F.when(long, p).otherwise(p + p * v * 0.5),
        "_sl": p * v * (1.5 + k * 0.5), "leverage": F.when(k < 0.3, 5).when(k < 0.5, 3).otherwise(1),
        "risk_percent": MAX_RISK_PER_TRADE * (1 - k * 0.3)})
    s = s.withColumn("stop_loss", F.when(long, p - c("_sl")).otherwise(p + c("_sl")))
    d = F.abs(p - c("stop_loss"))
    r1, r2 = F.when(k > 0.5, 1.5).otherwise(2.0), F.when(k > 0.5, 2.5).otherwise(3.0)
    sign = F.when(long, F.lit(1.0)).otherwise(-1.0)
    return s.withColumns({"take_profit_1": p + sign * d * r1, "take_profit_2": p + sign * d * r2,
                          "position_size_pct": F.least(c("risk_percent") * c("leverage"), F.lit(0.2))}).drop("_sl")


def calm_enough(vol: str = "volatility", average: str = "avg_volatility", limit: float = 2.5) -> Column:
    """Keep unless the current volatility exceeds the limit times its average (0 keeps)."""
    return F.coalesce((c(average) == 0) | (ratio(vol, average) <= limit), F.lit(True))


def signals(selected: DataFrame, market: DataFrame) -> DataFrame:
    """Signals of selected symbols that have a price and a volatility, calm ones only, at most five."""
    m = market.filter("price is not null and volatility is not null")
    s = entry_and_targets(selected.join(m, "symbol").filter(calm_enough()))
    s = s.withColumn("entry_range", F.format_string("%.2f-%.2f", c("entry_range_low"), c("entry_range_high")))
    return s.orderBy("rank").limit(MAX_POSITIONS)


def panel_bracket(df: DataFrame, price: str = "price", atr: str = "atr", signal: str = "meta_signal", level: str = "risk_level") -> DataFrame:
    """Bracket in multiples of the true range with distances in percent."""
    p, a = c(price), c(atr)
    sign = F.when(c(signal) == "LONG", F.lit(1.0)).otherwise(-1.0)
    df = df.withColumns({"entry_lo": p - a * 0.1, "entry_hi": p + a * 0.1, "sl": p - sign * a * 1.5, "tp1": p + sign * a * 2.25, "tp2": p + sign * a * 3.75})
    pct = lambda x: F.abs(c(x) - p) / p * 100
    return df.withColumns({"sl_pct": pct("sl"), "tp1_pct": pct("tp1"), "tp2_pct": pct("tp2"),
                           "panel_leverage": F.when(c(level) == "LOW", 5).when(c(level) == "MEDIUM", 3).otherwise(1)}).filter((p > 0) & (a > 0))


def risk_parameters(df: DataFrame, price: str = "price", vol: str = "volatility") -> DataFrame:
    k = F.least(F.greatest(c("risk_score"), F.lit(0.0)), F.lit(1.0))
    df = df.withColumns({
        "recommended_leverage": F.when(k < 0.3, 5).when(k < 0.5, 3).otherwise(1), "risk_per_trade": MAX_RISK_PER_TRADE * (1 - k * 0.5),
        "sl_distance": c(vol) * 1.5 * (1 + k), "_rr": F.when(k < 0.3, 2.5).when(k < 0.5, 2.0).otherwise(1.5)})
    df = df.withColumn("tp_distance", c("sl_distance") * c("_rr"))
    return df.withColumns({"sl_price_long": c(price) * (1 - c("sl_distance")), "sl_price_short": c(price) * (1 + c("sl_distance")),
                           "tp_price_long": c(price) * (1 + c("tp_distance")), "tp_price_short": c(price) * (1 - c("tp_distance"))}).drop("_rr")


# ---------------------------------------------------------------- Kelly


#: Fixed values.
MODEL_LEVERAGE = {"scalp": 10.0, "intraday": 5.0, "swing": 3.0}
KELLY = {"max_fraction": 0.25, "max_leverage": 5.0, "max_position": 0.10, "min_win_rate": 0.35, "base_volatility": 0.02, "min_size": 0.001}


def dampening(conf: Column) -> Column:
    return (F.when(conf >= 0.9, F.lit(1.0)).when(conf >= 0.7, 0.7 + (conf - 0.7) * 1.5).when(conf >= 0.5, 0.4 + (conf - 0.5) * 1.5).otherwise(conf * 0.8))


def adaptive_fraction(conf: Column, win: Column) -> Column:
    f = 0.25 + F.greatest((conf - 0.5) * 0.2, F.lit(0.0))
    return F.least(F.when((win < 0.4) | (win > 0.8), f * 0.8).otherwise(f), F.lit(0.25))


def kelly(df: DataFrame, mode: str = "quarter", win: str = "win_rate", payoff: str = "payoff_ratio", conf: str = "confidence",
          vol: str | None = "current_volatility", model: str = "model", capital: str = "capital", enough: Column | None = None) -> DataFrame:
    """Constrained Kelly size with the list of constraints that acted.

    ``enough`` false (too few trades) gives a zero size and the mark ``insufficient_data``.
    """
    bound = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    p, b, q = bound(c(win), 0.01, 0.99), F.greatest(c(payoff), F.lit(0.01)), bound(c(conf), 0.0, 1.0)
    df = df.withColumns({"_p": p, "_b": b, "_q": q})
    df = df.withColumn("_raw", (c("_p") * c("_b") - (1 - c("_p"))) / c("_b"))
    bad, low = c("_raw") <= 0, c("_p") < KELLY["min_win_rate"]
    fraction = adaptive_fraction(c("_q"), c("_p")) if mode == "adaptive" else F.lit({"quarter": 0.25, "half": 0.5, "full": 1.0}[mode])
    has_vol = F.coalesce(c(vol) > 0, F.lit(False)) if vol else F.lit(False)
    scaling = F.when(has_vol, bound(ratio(F.lit(KELLY["base_volatility"]), vol), 0.3, 1.5)).otherwise(1.0) if vol else F.lit(1.0)
    df = df.withColumns({
        "_half": F.when(low, c("_raw") * 0.5).otherwise(c("_raw")), "_fr": F.least(fraction, F.lit(KELLY["max_fraction"])),
        "_cd": dampening(c("_q")), "_vs": scaling, "_cap": F.least(lookup(c(model), MODEL_LEVERAGE, KELLY["max_leverage"]), F.lit(KELLY["max_leverage"]))})
    df = df.withColumn("_bet", c("_half") * c("_fr") * c("_cd") * c("_vs"))
    over = c("_bet") > KELLY["max_position"]
    sized = F.least(c("_bet"), F.lit(KELLY["max_position"]))
    levered = F.least(sized, c("_cap"))
    tiny = levered < KELLY["min_size"]
    share = F.when(tiny, 0.0).otherwise(levered)
    marks = reasons(F.when(low, "min_win_rate"), F.lit(f"kelly_mode_{mode}"), F.when(c("_q") < 0.7, "confidence_dampening"), F.when(has_vol, "volatility_scaling"),
                    F.when(over, "max_position_pct"), F.when(sized > c("_cap"), "leverage_cap"), F.when(tiny, "below_minimum"), sep=",")
    short = ~enough if enough is not None else F.lit(False)
    pick = lambda normal, none, few: F.when(short, few).when(bad, none).otherwise(normal)
    zero = F.lit(0.0)
    return df.withColumns({
        "raw_kelly": F.when(short, zero).when(bad, c("_raw")).otherwise(c("_half")), "kelly_fraction": pick(c("_fr"), zero, zero),
        "optimal_size": pick(share, zero, zero), "final_size": pick(share * c(capital), zero, zero),
        "confidence_adjustment": F.when(short, c(conf)).otherwise(pick(c("_cd"), c("_q"), c(conf))), "volatility_scaling": pick(c("_vs"), F.lit(1.0), F.lit(1.0)),
        "leverage_cap": pick(c("_cap"), zero, lookup(c(model), MODEL_LEVERAGE, KELLY["max_leverage"])),
        "constraints": pick(marks, F.lit("negative_kelly"), F.lit("insufficient_data")),
    }).drop("_p", "_b", "_q", "_raw", "_half", "_fr", "_cd", "_vs", "_cap", "_bet")


#: Second-engine multipliers and bounds.
CHAIN = {"fraction": 0.25, "lo": 0.01, "hi": 0.50}
CHAIN_VOL = {"low": 1.2, "medium": 1.0, "high": 0.6, "extreme": 0.2}
CHAIN_STATE = {"ON": 1.0, "REDUCED": 0.5, "OFF": 0.0}


def kelly_chain(df: DataFrame, win: str = "win_rate", payoff: str = "payoff_ratio", conf: str = "confidence", regime: str = "volatility_regime",
                state: str = "engine_state", utilization: str = "cvar_utilization") -> DataFrame:
    """Second-engine Kelly: dampen, cap, confidence squared, volatility, state, tail penalty, cap again."""
    cap = lambda x: F.least(F.greatest(x, F.lit(CHAIN["lo"])), F.lit(CHAIN["hi"]))
    raw = F.when((c(payoff) <= 0) | (c(win) <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), ratio(c(win) * c(payoff) - (1 - c(win)), payoff)))
    df = df.withColumn("_k0", raw)
    df = df.withColumn("_k1", c("_k0") * CHAIN["fraction"])
    df = df.withColumn("_k2", cap(c("_k1")))
    df = df.withColumn("_k3", c("_k2") * c(conf) * c(conf))
    df = df.withColumn("_k4", c("_k3") * lookup(c(regime), CHAIN_VOL, 0.5))
    df = df.withColumn("_k5", c("_k4") * lookup(c(state), CHAIN_STATE, 0.0))
    pen = c(utilization) > 0.5
    df = df.withColumn("_k6", F.when(pen, c("_k5") * F.greatest(F.lit(0.0), 1 - (c(utilization) - 0.5) * 2)).otherwise(c("_k5")))
    text = reasons(F.format_string("Raw Kelly: %.4f", c("_k0")), F.format_string("Dampened: %.4f", c("_k1")), F.format_string("Capped: %.4f", c("_k2")),
                   F.format_string("Confidence-scaled: %.4f", c("_k3")), F.format_string("Vol-scaled (%s): %.4f", c(regime), c("_k4")),
                   F.format_string("Risk-adjusted (%s): %.4f", c(state), c("_k5")), F.when(pen, F.format_string("CVaR-penalized: %.4f", c("_k6"))), sep=" → ")
    return df.withColumns({"kelly": cap(c("_k6")), "kelly_reasoning": text}).drop(*[f"_k{i}" for i in range(7)])


def kelly_check(df: DataFrame, win: str = "win_rate", avg_win: str = "avg_win", avg_loss: str = "avg_loss") -> DataFrame:
    """Validator form: quarter Kelly within 0 and .20, 0 below a win rate of .40."""
    b = ratio(avg_win, avg_loss)
    df = df.withColumn("full_kelly", ratio(c(win) * b - (1 - c(win)), b))
    df = df.withColumn("fractional_kelly", c("full_kelly") * 0.25)
    within = F.least(F.greatest(F.lit(0.0), c("fractional_kelly")), F.lit(0.20))
    return df.withColumns({"constrained": F.when(c(win) < 0.40, 0.0).otherwise(within), "passed_threshold": c(win) >= 0.40})


def hard_caps(leverage: Column, size: Column) -> tuple[Column, Column]:
    return F.least(leverage, F.lit(5.0)), F.least(size, F.lit(0.20))


# ---------------------------------------------------------------- admission, blocking, ensemble


def cvar_admission(cvar: Column, stress: Column, expected: Column, limit: Column) -> Column:
    """Rejection reason or null."""
    return (F.when(cvar > limit, "cvar over limit").when(stress > limit * 1.5, "stress over limit")
            .when((cvar > 0) & (ratio(expected, cvar) < 0.5), "reward to risk too low"))


def engine_admission(impact: Column, cvar: Column, limit: float = 0.03) -> Column:
    return F.when(cvar + impact > limit, "CVaR exceeds threshold").when(impact > limit * 0.5, "Trade CVaR impact too high")


def exposure_limit(cvar: Column, limit: float = 0.03) -> Column:
    return F.when(cvar >= limit, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - cvar / limit))


def score_gate(df: DataFrame, risk: str, stability_std: str, bad_share: Column) -> DataFrame:
    """Confidence of a score, block flag with reason and position factor."""
    r = c(risk)
    stable = F.coalesce(F.exp(-5 * c(stability_std)), F.lit(0.5))
    conf = (1 - bad_share) * 0.3 + stable * 0.4 + (0.5 + F.abs(r - 0.5)) * 0.3
    df = df.withColumn("score_confidence", F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)))
    k = c("score_confidence")
    return df.withColumns({"blocked": (r > 0.9) | (k < 0.2), "block_reason": F.when(r > 0.9, "risk").when(k < 0.2, "confidence"),
                           "position_factor": (1 - r) * (0.5 + 0.5 * k) * 0.25})


def exchange_signals(df: DataFrame) -> DataFrame:
    """Weighted direction of three models with conflict, severity and alignment bonus.

    Needs ``<model>_dir`` in (-1, 0, 1), ``<model>_conf`` and signed strengths ``<model>_sig``.
    """
    d = {m: c(f"{m}_dir") for m in MODELS}
    w = WEIGHTS
    nz = F.array_distinct(F.array_compact(F.array(*[F.when(x != 0, x) for x in d.values()])))
    pairs = [("scalp", "intraday"), ("intraday", "swing"), ("scalp", "swing")]
    sev = sum((F.abs(d[a] - d[b]) * (w[a] * w[b]) for a, b in pairs), F.lit(0.0))
    s = {m: c(f"{m}_sig") for m in MODELS}
    same = F.greatest(*[F.when(x > 0, 0).otherwise(1) for x in s.values()]) == 0
    same = same | (F.greatest(*[F.when(x < 0, 0).otherwise(1) for x in s.values()]) == 0)
    bonus = F.when(same, 1 + 0.2 * sum((F.abs(x) for x in s.values()), F.lit(0.0)) / 3).otherwise(1.0)
    df = df.withColumns({
        "weighted_direction": sum((d[m] * c(f"{m}_conf") * w[m] for m in MODELS), F.lit(0.0)), "avg_confidence": sum((c(f"{m}_conf") * w[m] for m in MODELS), F.lit(0.0)),
        "has_conflict": F.size(nz) > 1, "alignment_bonus": bonus})
    df = df.withColumns({
        "final_signal": F.when(c("weighted_direction") > 0.2, "BUY").when(c("weighted_direction") < -0.2, "SELL").otherwise("NEUTRAL"),
        "conflict_score": F.when(c("has_conflict"), sev).otherwise(0.0), "aligned_signal": sum((s[m] * w[m] for m in MODELS), F.lit(0.0)) * bonus})
    return df.withColumn("conflict_severity", F.when(c("conflict_score") > 0.5, "HIGH").when(c("conflict_score") > 0.2, "MEDIUM").otherwise("LOW"))


def ensemble_action(df: DataFrame) -> DataFrame:
    """Veto, hold, reduce or trade; the weak-signal check precedes the conflict check."""
    s = {m: c(f"{m}_sig") for m in MODELS}
    w = sum((s[m] * x for m, x in WEIGHTS.items()), F.lit(0.0))
    signs = F.array_distinct(F.array_compact(F.array(*[F.when(F.abs(x) > 0.25, F.signum(x)) for x in s.values()])))
    df = df.withColumns({"weighted": w, "_mixed": F.size(signs) > 1})
    act = F.when(c("risk_score") > 0.7, "VETO").when(F.abs("weighted") < 0.35, "HOLD").when(c("_mixed"), "REDUCE").when(c("weighted") > 0, "LONG").otherwise("SHORT")
    df = df.withColumn("action", act).drop("_mixed")
    return df.withColumn("size", F.when(c("action").isin("VETO", "HOLD"), "NONE").when(c("action") == "REDUCE", "HALF").otherwise("FULL"))


def should_disable(losses: Column, dd: Column) -> Column:
    return (losses >= 4) | (dd >= 0.10)


def assessment(df: DataFrame) -> DataFrame:
    """Recommendations from max_drawdown, cvar and sharpe_ratio."""
    text = reasons(
        F.when(c("max_drawdown") > 0.15, "HIGH RISK: Max drawdown exceeds 15%. Consider reducing position sizes."),
        F.when(c("cvar") > 0.05, "ELEVATED TAIL RISK: CVaR > 5%. Consider tighter stop losses."),
        F.when(c("sharpe_ratio") < 1.0, "LOW RISK-ADJUSTED RETURN: Sharpe < 1.0. Review strategy parameters."))
    return df.withColumn("recommendations", F.when(text == "", "System within acceptable risk parameters.").otherwise(text))


