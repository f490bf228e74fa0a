"""Votes, ranking, signals, ensemble rules, backtests: D1-D11, D15, D21, D25-D28, D30, K1-K6, J8-J12, V4-V7."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.operators import asof, backtest, decide, stats
from marketspark.plans import signals as plan
from marketspark.session import materialize
from workload.registry import DAILY, HOURLY, daily, hourly, query, r, rounded, table

c = F.col
MODELS = ("scalp", "intraday", "swing")

#: embeddings as three-model probabilities; some models are missing
PRED = """e AS (SELECT vec_id, 'S' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS symbol, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
 x AS (SELECT vec_id, symbol, """ + ", ".join(f"exp(v[{3 * i + j + 1}] * 4) AS {m}_{n}" for i, m in enumerate(MODELS) for j, n in enumerate("udf")) + """, abs(v[20]) * 3 AS rs FROM e),
 p0 AS (SELECT symbol, vec_id, """ + ", ".join(
    f"CASE WHEN vec_id % {7 + 2 * i} = 0 THEN NULL ELSE {m}_{n} / ({m}_u + {m}_d + {m}_f) END AS {m}_{k}" for i, m in enumerate(MODELS) for n, k in (("u", "P_up"), ("d", "P_down"), ("f", "P_flat"))) + """, rs AS risk_score FROM x)"""
FILL = PRED + ", p AS (SELECT symbol, vec_id, " + ", ".join(f"coalesce({m}_{k}, {v}) AS {m}_{k}" for m in MODELS for k, v in (("P_up", 0.33), ("P_down", 0.33), ("P_flat", 0.34))) + ", " + \
    ", ".join(f"coalesce({m}_P_up - {m}_P_down, 0) AS {m}_er" for m in MODELS) + ", risk_score FROM p0)"
MAX3 = {s: ", ".join(f"{m}_P_{s}" for m in MODELS) for s in ("up", "down")}
META = FILL + f""", d0 AS (SELECT *, 0.5 * scalp_P_up + 0.3 * intraday_P_up + 0.2 * swing_P_up AS score_long, 0.5 * scalp_P_down + 0.3 * intraday_P_down + 0.2 * swing_P_down AS score_short,
  0.5 * scalp_er + 0.3 * intraday_er + 0.2 * swing_er AS expected_return FROM p),
 d1 AS (SELECT *, CASE WHEN score_long > score_short THEN 'LONG' WHEN score_short > score_long THEN 'SHORT' ELSE 'NEUTRAL' END AS direction, CASE WHEN score_long = score_short THEN 0.5 ELSE greatest(score_long, score_short) END AS confidence FROM d0),
 d2 AS (SELECT *, CASE WHEN direction = 'LONG' THEN greatest({MAX3['up']}) ELSE greatest({MAX3['down']}) END AS hi, CASE WHEN direction = 'LONG' THEN least({MAX3['up']}) ELSE least({MAX3['down']}) END AS lo,
   CASE WHEN direction = 'LONG' THEN scalp_P_up ELSE scalp_P_down END AS a, CASE WHEN direction = 'LONG' THEN intraday_P_up ELSE intraday_P_down END AS b FROM d1),
 d3 AS (SELECT *, CASE WHEN direction = 'NEUTRAL' THEN 'none' WHEN hi - lo < 0.1 THEN 'multi' WHEN a = hi THEN 'scalp' WHEN b = hi THEN 'intraday' ELSE 'swing' END AS timeframe_used, concat_ws('; ', CASE WHEN confidence < 0.35 THEN printf('Low confidence (%.2f < 0.35)', confidence) END,
   CASE WHEN direction = 'LONG' AND swing_P_down > 0.5 THEN printf('Swing against LONG (P_down=%.2f)', swing_P_down) END, CASE WHEN direction = 'SHORT' AND swing_P_up > 0.5 THEN printf('Swing against SHORT (P_up=%.2f)', swing_P_up) END,
   CASE WHEN risk_score > 0.7 THEN printf('High risk (%.2f > 0.7)', risk_score) END, CASE WHEN direction = 'NEUTRAL' THEN 'No clear direction' END) AS why FROM d2),
 dec AS (SELECT *, why = '' AS should_trade, CASE WHEN why = '' THEN printf('All conditions met. Direction: %s, Confidence: %.2f', direction, confidence) ELSE why END AS reason FROM d3)"""


def raw_predictions(spark, sf):
    e = table(spark, sf, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x = e.select("vec_id", F.concat(F.lit("S"), F.lpad(c("vec_id").cast("string"), 6, "0")).alias("symbol"), (F.abs(v(19)) * 3).alias("risk_score"),
                 *[F.exp(v(3 * i + j) * 4).alias(f"{m}_{n}") for i, m in enumerate(MODELS) for j, n in enumerate("udf")])
    return x


def predictions(spark, sf):
    x = raw_predictions(spark, sf)
    outputs = {}
    for i, m in enumerate(MODELS):
        tot = c(f"{m}_u") + c(f"{m}_d") + c(f"{m}_f")
        o = x.filter(c("vec_id") % (7 + 2 * i) != 0).select("symbol", (c(f"{m}_u") / tot).alias("P_up"), (c(f"{m}_f") / tot).alias("P_flat"), (c(f"{m}_d") / tot).alias("P_down"))
        outputs[m] = o.withColumn("expected_return", c("P_up") - c("P_down"))
    return decide.assemble_predictions(x.select("symbol"), outputs, x)


def decisions(spark, sf):
    return decide.meta_decision(predictions(spark, sf))


@query("prediction_assembly", f"WITH {FILL} SELECT symbol, {', '.join(r(f'{m}_{k}', f'{m}_{k}') for m in MODELS for k in ('P_up', 'P_down', 'P_flat'))}, {r('risk_score', 'risk_score')} FROM p")
def assembly(spark, sf):
    return rounded(predictions(spark, sf).select("symbol", *[f"{m}_{k}" for m in MODELS for k in ("P_up", "P_down", "P_flat")], "risk_score"))


@query("meta_decision", f"WITH {META} SELECT symbol, direction, {r('confidence', 'confidence')}, {r('score_long', 'score_long')}, {r('score_short', 'score_short')}, timeframe_used, {r('expected_return', 'expected_return')}, should_trade, reason FROM dec")
def meta(spark, sf):
    return rounded(decisions(spark, sf).select("symbol", "direction", "confidence", "score_long", "score_short", "timeframe_used", "expected_return", "should_trade", "reason"))


@query("live_meta_score", "WITH " + PRED + f""", s AS (SELECT symbol, ({' + '.join(f"coalesce({w} * ({m}_P_up - {m}_P_down), 0)" for m, w in decide.WEIGHTS.items())}) / nullif({' + '.join(f"CASE WHEN {m}_P_up IS NULL THEN 0 ELSE {w} END" for m, w in decide.WEIGHTS.items())}, 0) AS x FROM p0)
  SELECT symbol, {r('coalesce(x, 0)', 'meta_score')}, CASE WHEN coalesce(x, 0) > 0.15 THEN 'LONG' WHEN coalesce(x, 0) < -0.15 THEN 'SHORT' ELSE 'NEUTRAL' END AS meta_signal FROM s""")
def live_meta(spark, sf):
    x = raw_predictions(spark, sf)
    for i, m in enumerate(MODELS):
        tot = c(f"{m}_u") + c(f"{m}_d") + c(f"{m}_f")
        ok = c("vec_id") % (7 + 2 * i) != 0
        x = x.withColumns({f"{m}_P_up": F.when(ok, c(f"{m}_u") / tot), f"{m}_P_down": F.when(ok, c(f"{m}_d") / tot)})
    return rounded(decide.live_meta(x).select("symbol", "meta_score", "meta_signal"))


@query("live_risk_bucket", f"""WITH {PRED}, b AS (SELECT symbol, least(greatest(risk_score, 0), 1) AS k FROM p0) SELECT symbol, {r('k', 'risk_clipped')}, CASE WHEN k < 0.25 THEN 'LOW' WHEN k < 0.5 THEN 'MEDIUM' WHEN k < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
  CASE WHEN k < 0.25 THEN 10.0::DOUBLE WHEN k < 0.5 THEN 5.0 WHEN k < 0.75 THEN 2.0 ELSE 1.0 END AS max_leverage FROM b""")
def risk_bucket(spark, sf):
    return rounded(decide.risk_bucket(raw_predictions(spark, sf)).select("symbol", "risk_clipped", "risk_level", "max_leverage"))


@query("class_and_confidence", f"""WITH {FILL} SELECT symbol, CASE WHEN scalp_P_down >= greatest(scalp_P_flat, scalp_P_up) THEN 0 WHEN scalp_P_flat >= scalp_P_up THEN 1 ELSE 2 END AS predicted_class, {r('greatest(scalp_P_down, scalp_P_flat, scalp_P_up)', 'confidence')}, {r('scalp_P_up - scalp_P_down', 'expected_return')} FROM p""")
def class_conf(spark, sf):
    k, conf, ret = decide.class_of(c("scalp_P_up"), c("scalp_P_flat"), c("scalp_P_down"))
    return rounded(predictions(spark, sf).select("symbol", k.alias("predicted_class"), conf.alias("confidence"), ret.alias("expected_return")))


RANK = META + """, rk AS (SELECT *, confidence * abs(expected_return) / greatest(risk_score, 0.1) AS final_score FROM dec WHERE should_trade), ranked AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, symbol) AS rank FROM rk WHERE final_score >= 0.1)"""


@query("coin_ranking", f"WITH {RANK} SELECT symbol, direction, {r('final_score', 'final_score')}, CAST(rank AS INTEGER) AS rank FROM ranked")
def ranking(spark, sf):
    return rounded(decide.rank_candidates(decisions(spark, sf)).select("symbol", "direction", "final_score", "rank"))


@query("top_five_uncorrelated", f"""WITH RECURSIVE {RANK}, vec AS (SELECT 'S' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS symbol, [CAST(x AS DOUBLE) for x in embedding[1:24]] AS r FROM embeddings),
 rv AS (SELECT ranked.symbol, rank, r FROM ranked JOIN vec USING (symbol)), last AS (SELECT max(rank) AS m FROM rv),
 walk(i, picked) AS (SELECT 0::BIGINT, []::STRUCT(s VARCHAR, r DOUBLE[])[] UNION ALL
   SELECT i + 1, CASE WHEN len(picked) < 5 AND len(list_filter(picked, lambda p: abs(coalesce(
      (list_dot_product(p.r, rv.r) - list_sum(p.r) * list_sum(rv.r) / 24) / sqrt((list_dot_product(p.r, p.r) - pow(list_sum(p.r), 2) / 24) * (list_dot_product(rv.r, rv.r) - pow(list_sum(rv.r), 2) / 24)), 0)) > 0.3)) = 0
     THEN list_append(picked, {{'s': rv.symbol, 'r': rv.r}}) ELSE picked END FROM walk JOIN rv ON rv.rank = walk.i + 1)
 SELECT unnest([p.s for p in picked]) AS symbol FROM walk, last WHERE i = m""")
def top_five(spark, sf):
    ret = table(spark, sf, "embeddings").select(F.concat(F.lit("S"), F.lpad(c("vec_id").cast("string"), 6, "0")).alias("symbol"), F.transform(F.slice("embedding", 1, 24), lambda x: x.cast("double")).alias("r"))
    return decide.select_uncorrelated(decide.rank_candidates(decisions(spark, sf)), ret, limit=0.3).select("symbol")


SIG = META + """, sg AS (SELECT symbol, direction, risk_score AS k, 10 + vec_id % 90 + 0.37 AS price, 0.005 + (vec_id % 23) / 1000.0 AS v FROM dec WHERE direction <> 'NEUTRAL'),
 s2 AS (SELECT *, CASE WHEN direction = 'LONG' THEN -1 ELSE 1 END AS sg, price * v * (1.5 + k * 0.5) AS dist FROM sg)"""


def market(spark, sf):
    d = decisions(spark, sf).filter("direction <> 'NEUTRAL'")
    i = F.substring("symbol", 2, 6).cast("long")
    return d.withColumns({"price": 10 + i % 90 + 0.37, "volatility": 0.005 + (i % 23) / 1000.0})


@query("signal_levels", f"""WITH {SIG} SELECT symbol, direction, {r("CASE WHEN direction = 'LONG' THEN price - price * v * 0.5 ELSE price END", 'entry_range_low')}, {r("CASE WHEN direction = 'LONG' THEN price ELSE price + price * v * 0.5 END", 'entry_range_high')},
  {r('price + sg * dist', 'stop_loss')}, {r('price - sg * dist * CASE WHEN k > 0.5 THEN 1.5 ELSE 2 END', 'take_profit_1')}, {r('price - sg * dist * CASE WHEN k > 0.5 THEN 2.5 ELSE 3 END', 'take_profit_2')},
  CASE WHEN k < 0.3 THEN 5 WHEN k < 0.5 THEN 3 ELSE 1 END AS leverage, {r('0.02 * (1 - k * 0.3)', 'risk_percent')}, {r('least(0.02 * (1 - k * 0.3) * CASE WHEN k < 0.3 THEN 5 WHEN k < 0.5 THEN 3 ELSE 1 END, 0.2)', 'position_size_pct')} FROM s2""")
def signal_levels(spark, sf):
    s = decide.entry_and_targets(market(spark, sf))
    return rounded(s.select("symbol", "direction", "entry_range_low", "entry_range_high", "stop_loss", "take_profit_1", "take_profit_2", "leverage", "risk_percent", "position_size_pct"))


@query("volatility_gate", f"""WITH {SIG} SELECT symbol, {r('v', 'volatility')} FROM s2 WHERE (k < 0.3 AND true AND (0.004 = 0 OR v / 0.004 <= 2.5)) OR k >= 0.3""")
def volatility_gate(spark, sf):
    m = market(spark, sf).withColumn("avg_volatility", F.when(c("risk_score") < 0.3, 0.004).otherwise(0.0))
    return rounded(m.filter(decide.calm_enough()).select("symbol", "volatility"))


@query("panel_bracket", f"""WITH {SIG} SELECT symbol, {r('price - v * 10', 'entry_lo')}, {r('price + v * 10', 'entry_hi')}, {r('price + sg * v * 150', 'sl')}, {r('price - sg * v * 225', 'tp1')}, {r('price - sg * v * 375', 'tp2')}, {r('v * 150 / price * 100', 'sl_pct')}, {r('v * 225 / price * 100', 'tp1_pct')},
  CASE WHEN least(greatest(k, 0), 1) < 0.25 THEN 5 WHEN least(greatest(k, 0), 1) < 0.5 THEN 3 ELSE 1 END AS panel_leverage FROM s2""")
def panel(spark, sf):
    m = decide.risk_bucket(market(spark, sf)).withColumns({"atr": c("volatility") * 100, "meta_signal": c("direction")})
    return rounded(decide.panel_bracket(m).select("symbol", "entry_lo", "entry_hi", "sl", "tp1", "tp2", "sl_pct", "tp1_pct", "panel_leverage"))


@query("risk_parameters", f"""WITH {SIG}, z AS (SELECT symbol, price, v, least(greatest(k, 0), 1) AS k FROM s2), y AS (SELECT *, v * 1.5 * (1 + k) AS sd, CASE WHEN k < 0.3 THEN 2.5 WHEN k < 0.5 THEN 2.0 ELSE 1.5 END AS rr FROM z)
  SELECT symbol, CASE WHEN k < 0.3 THEN 5 WHEN k < 0.5 THEN 3 ELSE 1 END AS recommended_leverage, {r('0.02 * (1 - k * 0.5)', 'risk_per_trade')}, {r('sd', 'sl_distance')}, {r('sd * rr', 'tp_distance')}, {r('price * (1 - sd)', 'sl_price_long')}, {r('price * (1 + sd * rr)', 'tp_price_long')} FROM y""")
def risk_parameters(spark, sf):
    return rounded(decide.risk_parameters(market(spark, sf)).select("symbol", "recommended_leverage", "risk_per_trade", "sl_distance", "tp_distance", "sl_price_long", "tp_price_long"))


ENS = META + """, en AS (SELECT symbol, risk_score, """ + ", ".join(f"{m}_er AS {m}_sig, CASE WHEN {m}_er > 0.1 THEN 1 WHEN {m}_er < -0.1 THEN -1 ELSE 0 END AS {m}_dir, greatest({m}_P_up, {m}_P_down) AS {m}_conf" for m in MODELS) + " FROM dec)"


def ensemble(spark, sf):
    d = decisions(spark, sf)
    return d.select("symbol", "risk_score", *[x for m in MODELS for x in (
        c(f"{m}_expected_return").alias(f"{m}_sig"),
        F.when(c(f"{m}_expected_return") > 0.1, 1).when(c(f"{m}_expected_return") < -0.1, -1).otherwise(0).alias(f"{m}_dir"), F.greatest(f"{m}_P_up", f"{m}_P_down").alias(f"{m}_conf"))])


@query("ensemble_exchange", f"""WITH {ENS}, w AS (SELECT *, {' + '.join(f'{m}_dir * {m}_conf * {x}' for m, x in decide.WEIGHTS.items())} AS wd, least(scalp_dir, intraday_dir, swing_dir) = -1 AND greatest(scalp_dir, intraday_dir, swing_dir) = 1 AS cf,
   CASE WHEN (scalp_sig > 0 AND intraday_sig > 0 AND swing_sig > 0) OR (scalp_sig < 0 AND intraday_sig < 0 AND swing_sig < 0) THEN 1 + 0.2 * (abs(scalp_sig) + abs(intraday_sig) + abs(swing_sig)) / 3 ELSE 1 END AS bonus FROM en),
  v AS (SELECT *, CASE WHEN cf THEN abs(scalp_dir - intraday_dir) * 0.15 + abs(intraday_dir - swing_dir) * 0.06 + abs(scalp_dir - swing_dir) * 0.10 ELSE 0 END AS cs FROM w)
  SELECT symbol, {r('wd', 'weighted_direction')}, CASE WHEN wd > 0.2 THEN 'BUY' WHEN wd < -0.2 THEN 'SELL' ELSE 'NEUTRAL' END AS final_signal, cf AS has_conflict, {r('cs', 'conflict_score')}, {r('bonus', 'alignment_bonus')},
   {r('(scalp_sig * 0.5 + intraday_sig * 0.3 + swing_sig * 0.2) * bonus', 'aligned_signal')} FROM v""")
def exchange(spark, sf):
    e = decide.exchange_signals(ensemble(spark, sf))
    return rounded(e.select("symbol", "weighted_direction", "final_signal", "has_conflict", "conflict_score", "alignment_bonus", "aligned_signal"))


@query("ensemble_action", f"""WITH {ENS}, w AS (SELECT *, scalp_sig * 0.5 + intraday_sig * 0.3 + swing_sig * 0.2 AS w, least(CASE WHEN abs(scalp_sig) > 0.25 THEN sign(scalp_sig) ELSE 9 END, CASE WHEN abs(intraday_sig) > 0.25 THEN sign(intraday_sig) ELSE 9 END, CASE WHEN abs(swing_sig) > 0.25 THEN sign(swing_sig) ELSE 9 END) = -1
   AND greatest(CASE WHEN abs(scalp_sig) > 0.25 THEN sign(scalp_sig) ELSE -9 END, CASE WHEN abs(intraday_sig) > 0.25 THEN sign(intraday_sig) ELSE -9 END, CASE WHEN abs(swing_sig) > 0.25 THEN sign(swing_sig) ELSE -9 END) = 1 AS mixed FROM en)
  SELECT symbol, {r('w', 'weighted')}, CASE WHEN risk_score > 0.7 THEN 'VETO' WHEN abs(w) < 0.35 THEN 'HOLD' WHEN mixed THEN 'REDUCE' WHEN w > 0 THEN 'LONG' ELSE 'SHORT' END AS action FROM w""")
def action(spark, sf):
    return rounded(decide.ensemble_action(ensemble(spark, sf)).select("symbol", "weighted", "action"))


@query("score_gate", f"""WITH {PRED}, a AS (SELECT symbol, vec_id, least(risk_score, 1) AS k, CASE WHEN count(*) OVER w = 10 THEN stddev_pop(least(risk_score, 1)) OVER w END AS s FROM p0 WINDOW w AS (ORDER BY vec_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, least(greatest((1 - (vec_id % 10) / 10.0) * 0.3 + coalesce(exp(-5 * s), 0.5) * 0.4 + (0.5 + abs(k - 0.5)) * 0.3, 0), 1) AS q FROM a)
  SELECT symbol, {r('q', 'score_confidence')}, k > 0.9 OR q < 0.2 AS blocked, {r('(1 - k) * (0.5 + 0.5 * q) * 0.25', 'position_factor')} FROM b""")
def score_gate(spark, sf):
    from marketspark.functions.series import Pieces, index_rows

    x = raw_predictions(spark, sf).select("symbol", "vec_id", F.least("risk_score", F.lit(1.0)).alias("k"))
    x = index_rows(x, [], ["vec_id"], F.floor(c("vec_id") / 4096))
    s = Pieces(x, keys=[], halo=16, block=16)
    s.stage(sd=s.std0("k", 10))
    g = decide.score_gate(s.close(), "k", "sd", (c("vec_id") % 10) / 10.0)
    return rounded(g.select("symbol", "score_confidence", "blocked", "position_factor"))


# ------------------------------------------------------------------ flagship and backtests


@query("trade_signals_flagship")
def flagship(spark, sf):
    b = materialize(daily(spark, sf, last=101).select("symbol", "ts", "pos", "n", "close"), "bars")  # the longest look back
    return plan.trade_signals(b, plan.momentum_outputs(b)).select(
        "symbol", "direction", "rank", F.round("final_score", 6).alias("final_score"), "timeframe_used", F.round("price", 4).alias("price"), "entry_range", F.round("stop_loss", 4).alias("stop_loss"),
        F.round("take_profit_1", 4).alias("take_profit_1"), F.round("take_profit_2", 4).alias("take_profit_2"), "leverage", F.round("risk_percent", 6).alias("risk_percent"), F.round("position_size_pct", 6).alias("position_size_pct"))


#: every hourly bar opens a signal; direction by position, stop 30 %, target 60 %
SIGNALS = HOURLY + """, sig AS (SELECT symbol, ts, pos, CASE WHEN pos % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, close AS entry, CASE WHEN pos % 2 = 0 THEN close * 0.3 ELSE close * 2.5 END AS sl,
   CASE WHEN pos % 2 = 0 THEN close * 2.2 ELSE close * 0.4 END AS tp FROM bars)"""


def bt_signals(bars):
    long = c("pos") % 2 == 0
    return bars.select("symbol", "ts", "pos", F.when(long, "LONG").otherwise("SHORT").alias("direction"), c("close").alias("entry"),
                                             F.when(long, c("close") * 0.3).otherwise(c("close") * 2.5).alias("sl"), F.when(long, c("close") * 2.2).otherwise(c("close") * 0.4).alias("tp"))


OUT = SIGNALS + """, hit AS (SELECT s.symbol, s.pos, min(b.pos) AS xp FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.pos > s.pos AND ((direction = 'LONG' AND (b.low <= sl OR b.high >= tp)) OR (direction = 'SHORT' AND (b.high >= sl OR b.low <= tp))) GROUP BY 1, 2),
 o AS (SELECT s.*, xp, b.low AS xl, b.high AS xh, b.ts AS xts, e.ts AS ets, e.close AS ec, e.pos AS ep FROM sig s LEFT JOIN hit h ON h.symbol = s.symbol AND h.pos = s.pos LEFT JOIN bars b ON b.symbol = s.symbol AND b.pos = h.xp JOIN bars e ON e.symbol = s.symbol AND e.pos = e.n - 1),
 oc AS (SELECT symbol, ts, pos, direction, entry, sl, tp, CASE WHEN xp IS NULL THEN 'timeout' WHEN (direction = 'LONG' AND xl <= sl) OR (direction = 'SHORT' AND xh >= sl) THEN 'sl' ELSE 'tp' END AS exit_reason, coalesce(xp, ep) AS exit_pos, coalesce(xts, ets) AS exit_ts, ec FROM o),
 oc2 AS (SELECT *, CASE exit_reason WHEN 'timeout' THEN ec WHEN 'sl' THEN sl ELSE tp END AS raw_exit FROM oc)"""


@query("bracket_outcomes", f"WITH {OUT} SELECT symbol, pos, direction, exit_reason, exit_pos, exit_ts, {r('raw_exit', 'raw_exit')} FROM oc2")
def bracket(spark, sf):
    b = hourly(spark, sf)
    return rounded(backtest.bracket_outcomes(bt_signals(b), b).select("symbol", "pos", "direction", "exit_reason", "exit_pos", "exit_ts", "raw_exit"))


COST = OUT + """, t0 AS (SELECT *, CASE WHEN direction = 'LONG' THEN entry * 1.0005 ELSE entry * 0.9995 END AS ep, CASE WHEN direction = 'LONG' THEN raw_exit * 0.9995 ELSE raw_exit * 1.0005 END AS xp, 1000 / entry AS size FROM oc2),
 t1 AS (SELECT *, CASE WHEN direction = 'LONG' THEN xp - ep ELSE ep - xp END * size - (ep + xp) * size * 0.001 AS pnl FROM t0)"""


@query("trade_cost_model", f"WITH {COST} SELECT symbol, pos, {r('ep', 'entry_price', 9)}, {r('xp', 'exit_price', 9)}, {r('(ep + xp) * size * 0.001', 'commission')}, {r('pnl', 'pnl')}, {r('pnl / (ep * size)', 'pnl_pct')} FROM t1")
def cost_model(spark, sf):
    b = hourly(spark, sf)
    t = backtest.trades(backtest.bracket_outcomes(bt_signals(b), b))
    return rounded(t.select("symbol", "pos", "entry_price", "exit_price", "commission", "pnl", "pnl_pct"), entry_price=9, exit_price=9)


CHAIN = COST.replace("bars AS (", "bars AS MATERIALIZED (", 1) + """, nx AS (SELECT t.symbol, t.pos, CASE WHEN t.exit_reason = 'timeout' THEN NULL ELSE (SELECT min(s.pos) FROM sig s WHERE s.symbol = t.symbol AND s.pos >= t.exit_pos) END AS nxt FROM t1 t),
 taken(symbol, pos) AS (SELECT symbol, min(pos) FROM sig GROUP BY 1 UNION ALL SELECT nx.symbol, nx.nxt FROM taken JOIN nx ON nx.symbol = taken.symbol AND nx.pos = taken.pos WHERE nx.nxt IS NOT NULL)"""


@query("one_position_backtest", f"WITH RECURSIVE {CHAIN} SELECT t.symbol, t.pos, direction, exit_reason, exit_pos, {r('pnl', 'pnl')} FROM t1 t JOIN taken k ON k.symbol = t.symbol AND k.pos = t.pos")
def one_position(spark, sf):
    b = hourly(spark, sf)
    t = backtest.trades(backtest.one_position(backtest.bracket_outcomes(bt_signals(b), b), rows=64))
    return rounded(t.select("symbol", "pos", "direction", "exit_reason", "exit_pos", "pnl"))


@query("signals_on_bars", f"WITH {SIGNALS} SELECT s.symbol, s.ts, direction, {r('b.high', 'high')}, {r('b.low', 'low')} FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.ts = s.ts")
def on_bars(spark, sf):
    b = hourly(spark, sf)
    return rounded(backtest.signals_on_bars(bt_signals(b).drop("pos"), b).select("symbol", "ts", "direction", "high", "low"))


@query("bars_at_times", f"WITH {HOURLY} SELECT symbol, ts, {r('close', 'close')} FROM bars WHERE ts IN (SELECT ts FROM bars WHERE symbol = 'view' AND pos % 5 = 0)")
def at_times(spark, sf):
    b = hourly(spark, sf)
    return rounded(backtest.at_times(b, b.filter("symbol = 'view' AND pos % 5 = 0")).select("symbol", "ts", "close"))


@query("bars_with_regime", f"WITH {HOURLY}, q AS (SELECT symbol, ts, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS x FROM bars) SELECT symbol, ts, CASE WHEN x > 0.05 THEN 'bull' WHEN x < -0.05 THEN 'bear' ELSE 'flat' END AS regime FROM q")
def regime_column(spark, sf):
    return backtest.with_regime(hourly(spark, sf)).select("symbol", "ts", "regime")


@query("time_blocks", f"WITH {HOURLY}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT ts FROM bars)) SELECT ts, k // (m // 5) AS block, k % (m // 5) >= floor((m // 5) * 0.7) AS is_test FROM t WHERE k // (m // 5) < 5")
def time_blocks(spark, sf):
    return backtest.time_blocks(hourly(spark, sf), 5, 0.7)


def run_sql(tags: str, tag: str, kind: str) -> str:
    """Backtest inside each value of ``tag``; ``tags`` are CTEs over ``bars0`` that end in ``tagged`` (bars with their tag)."""
    signals = HOURLY.replace("bars AS (", "bars0 AS MATERIALIZED (", 1) + f""", {tags}, bars AS MATERIALIZED (
      SELECT symbol || '|' || CAST({tag} AS VARCHAR) AS symbol, {tag}, ts, pos AS pos0, open, high, low, close,
             row_number() OVER g - 1 AS pos, count(*) OVER (PARTITION BY symbol, {tag}) AS n
      FROM tagged WINDOW g AS (PARTITION BY symbol, {tag} ORDER BY ts)),
     sig AS (SELECT symbol, {tag}, ts, pos, CASE WHEN pos0 % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, close AS entry,
             CASE WHEN pos0 % 2 = 0 THEN close * 0.3 ELSE close * 2.5 END AS sl, CASE WHEN pos0 % 2 = 0 THEN close * 2.2 ELSE close * 0.4 END AS tp FROM bars)"""
    chain = CHAIN[CHAIN.index(", hit AS"):]
    return f"""WITH RECURSIVE {signals}{chain},
     k AS (SELECT CAST(split_part(t.symbol, '|', 2) AS {kind}) AS {tag}, pnl, (epoch_us(exit_ts) - epoch_us(ts)) / 3.6e9 AS h FROM t1 t JOIN taken x ON x.symbol = t.symbol AND x.pos = t.pos),
     m AS (SELECT {tag}, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl <= 0) AS losing_trades,
             coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, coalesce(abs(sum(pnl) FILTER (pnl <= 0)), 1) AS loss,
             coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss, avg(pnl) AS avg_trade, avg(h) AS avg_duration_h FROM k GROUP BY 1)
     SELECT {tag}, total_trades, winning_trades, losing_trades, {r('gross_profit', 'gross_profit')}, {r('avg_win', 'avg_win')}, {r('avg_loss', 'avg_loss')}, {r('avg_trade', 'avg_trade')},
            {r('avg_duration_h', 'avg_duration_h')}, {r('winning_trades / total_trades', 'win_rate')}, {r('CASE WHEN loss > 0 THEN gross_profit / loss ELSE 0 END', 'profit_factor')},
            {r('winning_trades / total_trades * avg_win + (1 - winning_trades / total_trades) * avg_loss', 'expectancy')} FROM m"""


def block_sql(blocks: int, share: float, tag: str, keep: str) -> str:
    """Bars with their time block, see ``time_blocks``."""
    return f"""tk AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT ts FROM bars0)),
     tb AS (SELECT ts, k // (m // {blocks}) AS block, k % (m // {blocks}) >= floor((m // {blocks}) * {share}) AS is_test FROM tk WHERE k // (m // {blocks}) < {blocks}),
     tagged AS (SELECT b.*, {tag} FROM bars0 b JOIN tb USING (ts) WHERE {keep})"""


REGIMES = """rx AS (SELECT *, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS x FROM bars0),
 tagged AS (SELECT *, CASE WHEN x > 0.05 THEN 'bull' WHEN x < -0.05 THEN 'bear' ELSE 'flat' END AS regime FROM rx)"""
RUNS = {
    "backtest_walk_forward": (backtest.walk_forward, run_sql(block_sql(5, 0.7, "block", "is_test"), "block", "BIGINT")),
    "backtest_in_out_of_sample": (backtest.in_and_out_of_sample, run_sql(block_sql(1, 0.8, "CASE WHEN is_test THEN 'out_of_sample' ELSE 'in_sample' END AS sample", "true"), "sample", "VARCHAR")),
    "backtest_by_regime": (backtest.by_regime, run_sql(REGIMES, "regime", "VARCHAR")),
}
for _name, (_fn, _sql) in RUNS.items():
    def _bt(spark, sf, fn=_fn):
        b = hourly(spark, sf)
        return rounded(fn(bt_signals(b), b))

    query(_name, _sql)(_bt)


@query("backtest_noise")
def noise(spark, sf):
    b = hourly(spark, sf)
    return rounded(backtest.noise_runs(bt_signals(b), b))


@query("backtest_equity_metrics")
def bt_equity(spark, sf):
    b = materialize(hourly(spark, sf), "bars")
    t = materialize(backtest.trades(backtest.one_position(materialize(backtest.bracket_outcomes(bt_signals(b), b), "outcomes"))), "trades")
    eq = backtest.equity_curve(t.withColumn("account", F.lit("book")), ["account"]).select("account", "pos", c("exit_ts").alias("ts"), "equity")
    return rounded(stats.equity_metrics(eq, 10000.0))


@query("pairs_above_limit", f"""WITH {DAILY}, ret AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)
  SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, round(corr(a.x, b.x), 6) + 0.0 AS corr FROM ret a JOIN ret b ON a.k = b.k AND a.symbol < b.symbol AND a.k <= 24 GROUP BY 1, 2 HAVING abs(coalesce(corr(a.x, b.x), 0)) > 0.7""")
def pairs_above(spark, sf):
    return rounded(asof.pair_correlations(asof.last_returns(daily(spark, sf, last=25)), above=0.7))
