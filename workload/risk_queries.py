"""Risk statistics, drawdown states, Kelly sizes, engines: A9-A23, A40-A49, D12-D24, D29, D31, D32."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.functions.series import Pieces, index_rows, running, time_bucket
from marketspark.operators import decide, drawdown, riskengine, stats
from workload.registry import HOURLY, hourly, query, r, rounded, table
from workload.sqltext import BASE, W, over, staged, std

c = F.col
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
#: lineitem rows as trades: the return flag is the model, the account follows the supplier.
TRADES = f"""trades AS (SELECT CASE l_returnflag WHEN 'A' THEN 'scalp' WHEN 'N' THEN 'intraday' ELSE 'swing' END AS model, 'acc' || CAST(l_suppkey % 3 AS VARCHAR) AS account,
  l_extendedprice * (l_discount - l_tax) AS pnl, l_extendedprice * (l_discount - l_tax) / 100000 AS r, {', '.join(ORDER)} FROM lineitem)"""
KEY = ", ".join(ORDER)
INDEXED = TRADES + f""", tr AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {KEY}) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM trades)"""


def trades(spark, sf):
    li = table(spark, sf, "lineitem")
    pnl = c("l_extendedprice") * (c("l_discount") - c("l_tax"))
    return li.select(F.when(c("l_returnflag") == "A", "scalp").when(c("l_returnflag") == "N", "intraday").otherwise("swing").alias("model"),
                     F.concat(F.lit("acc"), (c("l_suppkey") % 3).cast("string")).alias("account"), pnl.alias("pnl"), (pnl / 100000).alias("r"), *ORDER)


def indexed(spark, sf, key="model"):
    return index_rows(trades(spark, sf), [key], ORDER, time_bucket("l_shipdate", 86_400), total="n")


# ------------------------------------------------------------------ tails

TAIL = TRADES + f""", k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {', '.join(x + ' DESC' for x in ORDER)}) AS rk FROM trades), l AS (SELECT model, -r AS loss FROM k WHERE rk <= 252),
 q AS (SELECT model, count(*) AS n_samples, quantile_cont(loss, 0.95) AS var, quantile_cont(loss, 0.99) AS p99, max(loss) AS max_loss FROM l GROUP BY 1),
 t AS (SELECT model, n_samples, var, p99, max_loss, avg(loss) FILTER (WHERE loss >= var) AS cvar, count(*) FILTER (WHERE loss >= var) AS tail_observations FROM l JOIN q USING (model) GROUP BY ALL),
 s AS (SELECT *, CASE WHEN p99 > cvar * 2 THEN greatest(cvar * 1.5, p99 * 1.2) ELSE cvar * 1.5 END AS stress_cvar FROM t)"""
LEVEL = "CASE WHEN cvar <= 0.01 THEN 'minimal' WHEN cvar <= 0.02 THEN 'low' WHEN cvar <= 0.05 THEN 'moderate' WHEN cvar <= 0.10 THEN 'high' WHEN cvar <= 0.15 THEN 'extreme' ELSE 'blocked' END"


@query("cvar_recent", f"""WITH {TAIL} SELECT model, n_samples, {r('var', 'var')}, {r('cvar', 'cvar')}, {r('stress_cvar', 'stress_cvar')}, {r('max_loss', 'max_loss')}, tail_observations,
  {LEVEL} AS risk_level, cvar > 0.08 OR stress_cvar > 0.12 AS is_blocked FROM s""")
def cvar_recent(spark, sf):
    return rounded(stats.recent_tail_risk(trades(spark, sf), ["model"], "r", ORDER))


@query("cvar_features", f"""WITH {TAIL} SELECT model, {r('cvar', 'model_cvar_95')}, {r('var', 'model_var_95')}, {r('max_loss', 'model_max_loss')}, {r('stress_cvar', 'model_cvar_stress')},
  CASE {LEVEL} WHEN 'minimal' THEN 0.0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 WHEN 'extreme' THEN 4 ELSE 5 END + 0.0 AS model_risk_level,
  {r('tail_observations / n_samples', 'model_tail_ratio')} FROM s""".replace("THEN 0.0 WHEN", "THEN CAST(0 AS DOUBLE) WHEN"))
def cvar_features(spark, sf):
    t = stats.loss_features(stats.recent_tail_risk(trades(spark, sf), ["model"], "r", ORDER))
    return rounded(t.select("model", *[x for x in t.columns if x.startswith("model_")]))


@query("cvar_whole_groups", f"""WITH {TRADES}, q AS (SELECT model, quantile_cont(r, 0.05) AS var FROM trades GROUP BY 1)
  SELECT model, {r('var', 'var')}, {r('avg(r) FILTER (WHERE r <= var)', 'cvar')}, count(*) AS n, count(*) FILTER (WHERE r <= var) AS n_tail, {r('min(r)', 'worst')} FROM trades JOIN q USING (model) GROUP BY model, var""")
def cvar_whole(spark, sf):
    return rounded(stats.return_tail(trades(spark, sf), ["model"], "r"))


@query("cvar_pooled_and_stressed", f"""WITH {TRADES}, x AS (SELECT r, CASE WHEN r < 0 THEN r * 2 ELSE r END AS s FROM trades), q AS (SELECT quantile_cont(r, 0.05) AS v, quantile_cont(s, 0.05) AS w FROM x)
  SELECT {r('avg(r) FILTER (WHERE r <= v)', 'pooled_cvar')}, {r('avg(s) FILTER (WHERE s <= w)', 'stress_cvar')} FROM x, q""")
def cvar_pooled(spark, sf):
    t = trades(spark, sf).withColumn("s", stats.stressed(c("r")))
    a = stats.return_tail(t, (), "r").select(c("cvar").alias("pooled_cvar"), F.lit(1).alias("k"))
    b = stats.return_tail(t, (), "s").select(c("cvar").alias("stress_cvar"), F.lit(1).alias("k"))
    return rounded(a.join(b, "k").drop("k"))


@query("worst_tail_mean", f"""WITH {TRADES}, k AS (SELECT model, r, row_number() OVER (PARTITION BY model ORDER BY r) AS i, greatest(1, floor(count(*) OVER (PARTITION BY model) * 0.01)) AS m FROM trades)
  SELECT model, CAST(max(m) AS BIGINT) AS n_tail, {r('avg(r)', 'worst_tail_mean')} FROM k WHERE i <= m GROUP BY 1""")
def worst_tail(spark, sf):
    return rounded(stats.worst_tail_mean(trades(spark, sf), ["model"], "r"))


@query("cvar_penalties", f"""WITH {TAIL} SELECT model, {r('cvar * 0.1', 'penalty')}, {r('CASE WHEN abs(cvar) > 0.03 THEN pow(abs(cvar) - 0.03, 2) * 100 ELSE 0 END', 'excess_penalty')} FROM s""")
def penalties(spark, sf):
    t = stats.recent_tail_risk(trades(spark, sf), ["model"], "r", ORDER)
    return rounded(t.select("model", stats.cvar_penalty(c("cvar")).alias("penalty"), stats.cvar_excess_penalty(c("cvar")).alias("excess_penalty")))


MODELS = ("scalp", "intraday", "swing")


@query("cvar_portfolio", f"""WITH {TRADES}, k AS (SELECT model, r, row_number() OVER (PARTITION BY model ORDER BY {', '.join(x + ' DESC' for x in ORDER)}) AS rk FROM trades),
 w AS (SELECT a.r AS a, b.r AS b, d.r AS d, (a.r * 0.3 + b.r * 0.5 + d.r * 0.2) AS p FROM k a JOIN k b ON a.rk = b.rk AND b.model = 'intraday' JOIN k d ON a.rk = d.rk AND d.model = 'swing' WHERE a.model = 'scalp' AND a.rk <= 252),
 q AS (SELECT quantile_cont(-p, 0.95) AS v, (corr(a, b) + corr(a, d) + corr(b, d)) / 3 AS rho, count(*) AS n FROM w)
 SELECT 'portfolio' AS model, max(n) AS n_samples, {r('max(v)', 'var')}, {r('avg(-p) FILTER (WHERE -p >= v) * CASE WHEN max(rho) > 0.7 THEN 0.5 + max(rho) ELSE 1 END', 'cvar')}, {r('max(rho)', 'avg_correlation')} FROM w, q""")
def cvar_portfolio(spark, sf):
    t = stats.portfolio_tail_risk(trades(spark, sf), "model", "r", ORDER, MODELS, {"scalp": 0.3, "intraday": 0.5, "swing": 0.2})
    return rounded(t.select("model", "n_samples", "var", "cvar", "avg_correlation"))


@query("cvar_rolling", staged(f"{INDEXED}, bars AS (SELECT model AS symbol, l_shipdate AS ts, pos, n, -r AS loss FROM tr)", [
    {"l60": f"list(loss) {over(60)}", "v": f"quantile_cont(loss, 0.95) {over(60)}"},
    {"cvar": "CASE WHEN pos >= 29 THEN list_aggregate(list_filter(l60, lambda x: x >= v), 'avg') END"}], ["cvar"], keys="symbol, pos"))
def cvar_rolling(spark, sf):
    s = Pieces(indexed(spark, sf).withColumn("_loss", -c("r")), keys=["model"], halo=64, block=64)
    w = s.back(60)
    s.stage(_w=F.collect_list("_loss").over(w), _v=F.percentile("_loss", 0.95).over(w))
    tail = F.filter("_w", lambda x: x >= c("_v"))
    s.stage(cvar=F.when(c("pos") >= 29, F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)))
    return rounded(s.close().select(c("model").alias("symbol"), "pos", "cvar"))


@query("cvar_limit_table", f"""WITH {TRADES}, q AS (SELECT conf, quantile_cont(r, 1 - conf) AS v FROM trades, (VALUES (0.90::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(conf) GROUP BY 1),
  t AS (SELECT conf, max(v) AS v, avg(r) FILTER (WHERE r <= v) AS cv FROM trades, q GROUP BY 1), m(model, f, lim) AS (VALUES ('scalp', 1.2::DOUBLE, 0.05::DOUBLE), ('intraday', 1.0, 0.07), ('swing', 0.8, 0.10), ('portfolio', 0.3 * 1.2 + 0.5 + 0.2 * 0.8, 0.08))
  SELECT conf AS confidence, model, {r('-v * f', 'var')}, {r('-cv * f', 'cvar')}, lim AS "limit", -cv * f < lim AS within_limit FROM t, m""".replace("quantile_cont(r, 1 - conf)", "CASE conf WHEN 0.90 THEN quantile_cont(r, 0.1) WHEN 0.95 THEN quantile_cont(r, 0.05) ELSE quantile_cont(r, 0.01) END"))
def limit_table(spark, sf):
    return rounded(stats.limit_table(trades(spark, sf), "r"))


# ------------------------------------------------------------------ payoff and Kelly

PAYOFF = f"""{TRADES}, pay AS (SELECT model, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate, coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0.01) AS avg_win,
  coalesce(abs(avg(pnl) FILTER (WHERE pnl < 0)), 0.01) AS avg_loss FROM trades GROUP BY 1), pp AS (SELECT *, avg_win / greatest(avg_loss, 0.01) AS payoff_ratio FROM pay)"""


@query("payoff_statistics", f"WITH {PAYOFF} SELECT model, n_trades, {r('win_rate', 'win_rate')}, {r('avg_win', 'avg_win')}, {r('avg_loss', 'avg_loss')}, {r('payoff_ratio', 'payoff_ratio')} FROM pp")
def payoff_statistics(spark, sf):
    return rounded(stats.payoff(trades(spark, sf), ["model"], "pnl"))


#: orders as Kelly inputs
KELLY_IN = """kin AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'scalp' WHEN 1 THEN 'intraday' WHEN 2 THEN 'swing' ELSE 'other' END AS model, (o_custkey % 97) / 97.0 AS win_rate,
  (o_orderkey % 31) / 10.0 AS payoff_ratio, (o_orderkey % 101) / 100.0 AS confidence, (o_custkey % 9) / 100.0 AS current_volatility, 10000.0::DOUBLE AS capital FROM orders)"""


def kelly_inputs(spark, sf):
    k = c("o_orderkey") % 4
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k == 0, "scalp").when(k == 1, "intraday").when(k == 2, "swing").otherwise("other").alias("model"), ((c("o_custkey") % 97) / 97.0).alias("win_rate"),
        ((c("o_orderkey") % 31) / 10.0).alias("payoff_ratio"), ((c("o_orderkey") % 101) / 100.0).alias("confidence"), ((c("o_custkey") % 9) / 100.0).alias("current_volatility"), F.lit(10000.0).alias("capital"))


KELLY_SQL = KELLY_IN + """, k0 AS (SELECT *, least(greatest(win_rate, 0.01), 0.99) AS p, greatest(payoff_ratio, 0.01) AS b, least(greatest(confidence, 0), 1) AS q FROM kin),
 k1 AS (SELECT *, (p * b - (1 - p)) / b AS raw FROM k0),
 k2 AS (SELECT *, CASE WHEN p < 0.35 THEN raw * 0.5 ELSE raw END AS half, {fraction} AS fr, CASE WHEN q >= 0.9 THEN 1 WHEN q >= 0.7 THEN 0.7 + (q - 0.7) * 1.5 WHEN q >= 0.5 THEN 0.4 + (q - 0.5) * 1.5 ELSE q * 0.8 END AS cd,
   CASE WHEN current_volatility > 0 THEN least(greatest(0.02 / nullif(current_volatility, 0), 0.3), 1.5) ELSE 1 END AS vs, CASE model WHEN 'swing' THEN 3.0 ELSE 5.0 END AS cap FROM k1),
 k3 AS (SELECT *, half * fr * cd * vs AS bet FROM k2), k4 AS (SELECT *, least(least(bet, 0.1), cap) AS size0 FROM k3),
 k5 AS (SELECT *, CASE WHEN raw <= 0 THEN 0 WHEN size0 < 0.001 THEN 0 ELSE size0 END AS share FROM k4)
 SELECT o_orderkey, round(CASE WHEN raw <= 0 THEN raw ELSE half END, 6) + 0.0 AS raw_kelly, CAST(round(CASE WHEN raw <= 0 THEN 0 ELSE fr END, 6) AS DOUBLE) + 0.0 AS kelly_fraction, round(share, 6) + 0.0 AS optimal_size,
  round(share * capital, 6) + 0.0 AS final_size, CASE WHEN raw <= 0 THEN 'negative_kelly' ELSE concat_ws(',', CASE WHEN p < 0.35 THEN 'min_win_rate' END, '{mode}', CASE WHEN q < 0.7 THEN 'confidence_dampening' END,
   CASE WHEN current_volatility > 0 THEN 'volatility_scaling' END, CASE WHEN bet > 0.1 THEN 'max_position_pct' END, CASE WHEN size0 < 0.001 THEN 'below_minimum' END) END AS constraints FROM k5"""
ADAPT = "least((0.25 + greatest((q - 0.5) * 0.2, 0)) * CASE WHEN p < 0.4 OR p > 0.8 THEN 0.8 ELSE 1 END, 0.25)"

for _mode, _fr in (("quarter", "0.25"), ("adaptive", ADAPT), ("half", "least(0.5, 0.25)")):
    def _kelly(spark, sf, mode=_mode):
        k = decide.kelly(kelly_inputs(spark, sf), mode=mode)
        return rounded(k.select("o_orderkey", "raw_kelly", "kelly_fraction", "optimal_size", "final_size", "constraints"))

    query(f"kelly_{_mode}", "WITH " + KELLY_SQL.replace("{fraction}", _fr).replace("{mode}", f"kelly_mode_{_mode}"))(_kelly)


@query("kelly_from_trades", f"""WITH {PAYOFF}, z AS (SELECT model, n_trades, least(greatest(win_rate, 0.01), 0.99) AS p, greatest(payoff_ratio, 0.01) AS b FROM pp), y AS (SELECT *, (p * b - (1 - p)) / b AS raw FROM z),
  x AS (SELECT *, raw * 0.25 * (0.7 + (0.8 - 0.7) * 1.5) AS bet FROM y)
  SELECT model, CASE WHEN n_trades < 30 THEN 'insufficient_data' WHEN raw <= 0 THEN 'negative_kelly' ELSE concat_ws(',', 'kelly_mode_quarter', CASE WHEN bet > 0.1 THEN 'max_position_pct' END, CASE WHEN least(bet, 0.1) < 0.001 THEN 'below_minimum' END) END AS constraints,
   {r('CASE WHEN n_trades < 30 OR raw <= 0 OR least(bet, 0.1) < 0.001 THEN 0 ELSE least(bet, 0.1) END', 'optimal_size')} FROM x""")
def kelly_trades(spark, sf):
    p = stats.payoff(trades(spark, sf), ["model"], "pnl").withColumns({"confidence": F.lit(0.8), "capital": F.lit(10000.0)})
    return rounded(decide.kelly(p, vol=None, enough=c("n_trades") >= 30).select("model", "constraints", "optimal_size"))


CHAIN_IN = KELLY_IN + """, ci AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'extreme' ELSE 'odd' END AS regime, CASE o_orderkey % 3 WHEN 0 THEN 'ON' WHEN 1 THEN 'REDUCED' ELSE 'OFF' END AS state,
  (o_custkey % 13) / 12.0 AS u FROM kin), c0 AS (SELECT *, CASE WHEN payoff_ratio <= 0 OR win_rate <= 0 THEN 0 ELSE greatest(0, (win_rate * payoff_ratio - (1 - win_rate)) / nullif(payoff_ratio, 0)) END AS k0 FROM ci),
 c1 AS (SELECT *, least(greatest(k0 * 0.25, 0.01), 0.5) * confidence * confidence * CASE regime WHEN 'low' THEN 1.2 WHEN 'medium' THEN 1.0 WHEN 'high' THEN 0.6 WHEN 'extreme' THEN 0.2 ELSE 0.5 END
   * CASE state WHEN 'ON' THEN 1.0 WHEN 'REDUCED' THEN 0.5 ELSE 0 END * CASE WHEN u > 0.5 THEN greatest(0, 1 - (u - 0.5) * 2) ELSE 1 END AS k6 FROM c0)"""


@query("kelly_chain", f"WITH {CHAIN_IN} SELECT o_orderkey, {r('least(greatest(k6, 0.01), 0.5)', 'kelly')} FROM c1")
def kelly_chain(spark, sf):
    k5, k3 = c("o_orderkey") % 5, c("o_orderkey") % 3
    d = kelly_inputs(spark, sf).withColumns({
        "volatility_regime": F.when(k5 == 0, "low").when(k5 == 1, "medium").when(k5 == 2, "high").when(k5 == 3, "extreme").otherwise("odd"),
        "engine_state": F.when(k3 == 0, "ON").when(k3 == 1, "REDUCED").otherwise("OFF")})
    d = d.join(table(spark, sf, "orders").select("o_orderkey", ((c("o_custkey") % 13) / 12.0).alias("cvar_utilization")), "o_orderkey")
    return rounded(decide.kelly_chain(d).select("o_orderkey", "kelly"))


@query("kelly_validator", f"""WITH {PAYOFF}, z AS (SELECT model, win_rate, avg_win / avg_loss AS b FROM pp), y AS (SELECT *, (win_rate * b - (1 - win_rate)) / b AS k FROM z)
  SELECT model, {r('k', 'full_kelly')}, {r('k * 0.25', 'fractional_kelly')}, {r('CASE WHEN win_rate < 0.4 THEN 0 ELSE least(greatest(0, k * 0.25), 0.2) END', 'constrained')}, win_rate >= 0.4 AS passed_threshold FROM y""")
def kelly_validator(spark, sf):
    k = decide.kelly_check(stats.payoff(trades(spark, sf), ["model"], "pnl"))
    return rounded(k.select("model", "full_kelly", "fractional_kelly", "constrained", "passed_threshold"))


# ------------------------------------------------------------------ equity

EQUITY = TRADES + """, dayr AS (SELECT account, l_shipdate AS ts, sum(r - 0.005) AS r, sum(pnl) AS pnl FROM trades GROUP BY 1, 2),
 eq AS (SELECT account, ts, pnl, r, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY account) AS n, round(10000 * exp(0.2 * sum(r) OVER (w ROWS UNBOUNDED PRECEDING)), 3) AS equity FROM dayr WINDOW w AS (PARTITION BY account ORDER BY ts))"""
AW = "PARTITION BY account ORDER BY pos"


def equity(spark, sf):
    """Daily equity of three accounts, scaled so that every drawdown state and recovery occurs."""
    d = trades(spark, sf).groupBy("account", c("l_shipdate").alias("ts")).agg(F.sum(c("r") - 0.005).alias("r"), F.sum("pnl").alias("pnl"))
    d = index_rows(d, ["account"], ["ts"], time_bucket("ts", 90 * 86_400), total="n")
    d = running(d, ["account"], ["pos"], F.floor(c("pos") / 512), {"cum": ("sum", c("r"))})
    return d.withColumn("equity", F.round(10000 * F.exp(0.2 * c("cum")), 3)).drop("cum")


STATES = EQUITY + f""", s0 AS (SELECT *, greatest(10000, max(equity) OVER ({AW})) AS peak_equity FROM eq), s1 AS (SELECT *, (peak_equity - equity) / peak_equity AS dd FROM s0),
 s2 AS (SELECT *, max(dd) OVER ({AW}) AS max_drawdown, sum(CASE WHEN dd < 0.025 THEN 1 ELSE 0 END) OVER ({AW}) AS island, max(CASE WHEN dd <= 0 THEN pos END) OVER ({AW}) AS top,
   CASE WHEN pos >= 4 THEN lag(equity, 4) OVER ({AW}) WHEN pos = 3 THEN 10000 END AS back4 FROM s1), s3 AS (SELECT *, max(dd) OVER (PARTITION BY account, island ORDER BY pos) AS worst FROM s2),
 st AS (SELECT *, CASE WHEN dd >= 0.25 THEN 'emergency' WHEN dd >= 0.20 THEN 'risk_off' WHEN dd >= 0.15 THEN 'minimal_risk' WHEN dd >= 0.05 THEN 'reduced_risk' ELSE 'full_risk' END AS risk_state,
   CASE WHEN dd < 0.05 THEN 1 WHEN dd < 0.10 THEN 1 - 0.25 * (dd - 0.05) / 0.05 WHEN dd < 0.15 THEN 0.75 - 0.25 * (dd - 0.10) / 0.05 WHEN dd < 0.20 THEN 0.5 - 0.25 * (dd - 0.15) / 0.05 ELSE 0 END AS risk_multiplier,
   max_drawdown >= 0.25 AS emergency, {', '.join(f"CASE WHEN worst >= {o} THEN 'disabled' WHEN worst >= {lo} THEN 'reduced' ELSE 'enabled' END AS {m}_state" for m, (lo, o) in drawdown.MODEL_LEVELS.items())} FROM s3)"""


@query("drawdown_states", f"""WITH {STATES} SELECT account, pos, {r('peak_equity', 'peak_equity')}, {r('dd', 'current_drawdown')}, {r('max_drawdown', 'max_drawdown')}, pos - coalesce(top, -1) AS drawdown_duration,
  {r('CASE WHEN max_drawdown > 0 THEN 1 - dd / max_drawdown ELSE 1 END', 'recovery_ratio')}, {r('coalesce((back4 - equity) / (peak_equity * 4), 0)', 'drawdown_velocity')}, risk_state, {r('risk_multiplier', 'risk_multiplier')}, emergency,
  scalp_state, intraday_state, swing_state FROM st""")
def drawdown_states(spark, sf):
    s = drawdown.equity_states(equity(spark, sf), rows=512)
    return rounded(s.select("account", "pos", "peak_equity", "current_drawdown", "max_drawdown", "drawdown_duration", "recovery_ratio", "drawdown_velocity", "risk_state", "risk_multiplier", "emergency",
                            "scalp_state", "intraday_state", "swing_state"))


@query("drawdown_events", f"""WITH {STATES}, lg AS (SELECT *, {', '.join(f"CASE WHEN pos = 0 THEN '{d}' ELSE lag({n}) OVER ({AW}) END AS was_{n}" for n, d in (('risk_state', 'full_risk'), ('scalp_state', 'enabled'), ('intraday_state', 'enabled'), ('swing_state', 'enabled')))} FROM st)
  {' UNION ALL '.join(f"SELECT account, pos, '{w}' AS what, was_{n} AS from_state, {n} AS to_state, round(dd, 6) + 0.0 AS current_drawdown, equity FROM lg WHERE {n} <> was_{n}" for n, w in (('risk_state', 'risk'), ('scalp_state', 'scalp'), ('intraday_state', 'intraday'), ('swing_state', 'swing')))}""")
def drawdown_events(spark, sf):
    return rounded(drawdown.state_events(drawdown.equity_states(equity(spark, sf))))


@query("drawdown_features", f"""WITH {STATES} SELECT account, pos, {r('dd', 'dd_current')}, {r('max_drawdown', 'dd_max')}, CAST(list_position(['full_risk', 'reduced_risk', 'minimal_risk', 'risk_off', 'emergency'], risk_state) - 1 AS INTEGER) AS dd_risk_state,
  CAST(({' + '.join(f"CAST({m}_state = 'enabled' AS INT)" for m in MODELS)}) AS INTEGER) AS dd_models_enabled, CAST(({' + '.join(f"CAST({m}_state = 'disabled' AS INT)" for m in MODELS)}) AS INTEGER) AS dd_models_disabled FROM st""")
def drawdown_features(spark, sf):
    f = drawdown.state_features(drawdown.equity_states(equity(spark, sf)))
    return rounded(f.select("account", "pos", "dd_current", "dd_max", "dd_risk_state", "dd_models_enabled", "dd_models_disabled"))


ENGINE_STATES = EQUITY + f""", e0 AS (SELECT *, greatest(0, max(equity) OVER ({AW})) AS pk FROM eq), e1 AS (SELECT *, (pk - equity) / pk AS dd FROM e0), e2 AS (SELECT *, max(dd) OVER ({AW}) AS mdd, sum(CASE WHEN dd < 0.05 THEN 1 ELSE 0 END) OVER ({AW}) AS island FROM e1),
 e3 AS (SELECT *, max(dd) OVER (PARTITION BY account, island ORDER BY pos) AS worst FROM e2), es AS (SELECT *, CASE WHEN dd >= 0.15 THEN 'OFF' WHEN dd >= 0.10 THEN 'REDUCED' ELSE 'ON' END AS engine_state,
 CASE WHEN dd < 0.05 THEN 1 WHEN dd < 0.10 THEN 1 - 0.5 * (dd - 0.05) / 0.05 WHEN dd < 0.15 THEN 0.25 ELSE 0 END AS dd_multiplier, worst > 0.10 AS scalp_disabled, worst > 0.15 AS intraday_disabled FROM e3)"""


@query("engine_drawdown_states", f"WITH {ENGINE_STATES} SELECT account, pos, {r('dd', 'current_drawdown')}, {r('mdd', 'max_drawdown')}, engine_state, {r('dd_multiplier', 'dd_multiplier')}, scalp_disabled, intraday_disabled FROM es")
def engine_states(spark, sf):
    s = drawdown.engine_equity_states(equity(spark, sf))
    return rounded(s.select("account", "pos", "current_drawdown", "max_drawdown", "engine_state", "dd_multiplier", "scalp_disabled", "intraday_disabled"))


@query("kill_switch_auto", f"""WITH {EQUITY}, p AS (SELECT *, coalesce(lag(equity) OVER ({AW}), 10000) AS day_start, max(equity) OVER ({AW}) AS pk, max(CASE WHEN pnl > 0 THEN pos END) OVER ({AW}) AS win FROM eq),
  t AS (SELECT account, pos, pos - coalesce(win, -1) AS consecutive_losses, (pk - equity) / pk AS drawdown, (day_start - equity) / day_start AS daily_loss FROM p), k AS (SELECT *, drawdown > 0.2 OR consecutive_losses > 5 OR daily_loss > 0.05 AS trigger FROM t)
  SELECT account, pos, consecutive_losses, {r('drawdown', 'drawdown')}, {r('daily_loss', 'daily_loss')}, trigger, bool_or(trigger) OVER ({AW}) AS kill_switch FROM k""")
def kill_switch(spark, sf):
    e = equity(spark, sf)
    s = Pieces(e, keys=["account"], halo=8, block=8)
    e = s.stage(day_start_equity=F.coalesce(s.lag("equity"), F.lit(10000.0))).close()
    k = drawdown.auto_kill(e)
    return rounded(k.select("account", "pos", "consecutive_losses", "drawdown", "daily_loss", "trigger", "kill_switch"))


@query("equity_metrics", f"""WITH {EQUITY}, a AS (SELECT *, max(equity) OVER ({AW}) AS pk, equity / lag(equity) OVER ({AW}) - 1 AS ret FROM eq), b AS (SELECT account, arg_max(equity, pos) AS fe, greatest(1, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)) AS days,
  abs(min(equity - pk)) AS mdd, arg_min(pk, (equity - pk, pos)) AS pka, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (WHERE ret < 0) AS d FROM a GROUP BY 1)
  SELECT account, fe AS final_equity, CAST(days AS BIGINT) AS days, {r('mdd', 'max_drawdown')}, {r('fe - 10000', 'total_return')}, {r('(fe - 10000) / 10000', 'total_return_pct')}, {r('pow(fe / 10000, 365.0 / days) - 1', 'annualized_return')}, {r('mdd / pka', 'max_drawdown_pct')},
  {r('m / s * sqrt(252)', 'sharpe_ratio')}, {r('m / d * sqrt(252)', 'sortino_ratio')}, {r('(pow(fe / 10000, 365.0 / days) - 1) / (mdd / pka)', 'calmar_ratio')} FROM b""")
def equity_metrics(spark, sf):
    return rounded(stats.equity_metrics(equity(spark, sf), 10000.0))


@query("trade_metrics", f"""WITH {TRADES} SELECT model, count(*) AS total_trades, count(*) FILTER (WHERE pnl > 0) AS winning_trades, count(*) FILTER (WHERE pnl <= 0) AS losing_trades, {r('sum(pnl) FILTER (WHERE pnl > 0)', 'gross_profit', 3)},
  {r('avg(pnl) FILTER (WHERE pnl > 0)', 'avg_win')}, {r('avg(pnl) FILTER (WHERE pnl <= 0)', 'avg_loss')}, {r('avg(pnl)', 'avg_trade')}, {r('avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END)', 'win_rate')},
  {r('sum(pnl) FILTER (WHERE pnl > 0) / abs(sum(pnl) FILTER (WHERE pnl <= 0))', 'profit_factor')}, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) * avg(pnl) FILTER (WHERE pnl > 0) + (1 - avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END)) * avg(pnl) FILTER (WHERE pnl <= 0), 6) + 0.0 AS expectancy
  FROM trades GROUP BY 1""")
def trade_metrics(spark, sf):
    return rounded(stats.trade_metrics(trades(spark, sf), ["model"]), gross_profit=3)


@query("win_loss_streaks", f"""WITH {INDEXED}, i AS (SELECT model, pnl > 0 AS win, pos - row_number() OVER (PARTITION BY model, pnl > 0 ORDER BY pos) AS g FROM tr), l AS (SELECT model, win, g, count(*) AS k FROM i GROUP BY ALL)
  SELECT model, max(k) FILTER (WHERE win) AS max_win_streak, max(k) FILTER (WHERE NOT win) AS max_loss_streak FROM l GROUP BY 1""")
def win_loss(spark, sf):
    return stats.streaks(indexed(spark, sf), ["model"])


@query("model_disable_rule", f"""WITH {INDEXED}, i AS (SELECT model, pnl > 0 AS win, pos - row_number() OVER (PARTITION BY model, pnl > 0 ORDER BY pos) AS g FROM tr), l AS (SELECT model, max(k) AS m FROM (SELECT model, win, g, count(*) AS k FROM i WHERE NOT win GROUP BY ALL) GROUP BY 1)
  SELECT model, m >= 4 OR 0.05 >= 0.10 AS disable FROM l""")
def disable_rule(spark, sf):
    return stats.streaks(indexed(spark, sf), ["model"]).select("model", decide.should_disable(c("max_loss_streak"), F.lit(0.05)).alias("disable"))


BUNDLE = INDEXED + """, g AS (SELECT model, r, pos, exp(sum(ln(1 + r / 50)) OVER (PARTITION BY model ORDER BY pos)) AS eq, r / 50 AS x, quantile_cont(r / 50, 0.05) OVER (PARTITION BY model) AS p05 FROM tr),
 h AS (SELECT *, max(eq) OVER (PARTITION BY model ORDER BY pos) AS pk, eq - lag(eq) OVER (PARTITION BY model ORDER BY pos) AS step FROM g),
 bun AS (SELECT model, count(*) AS n, abs(avg(x) FILTER (WHERE x <= p05)) AS cvar, max((pk - eq) / (pk + 1e-10)) AS max_drawdown, avg(CASE WHEN x < p05 THEN 1 ELSE 0 END) AS tail_loss_frequency, avg(x) / stddev_pop(x) * sqrt(252) AS sharpe_ratio,
  avg(x) / stddev_pop(x) FILTER (WHERE x < 0) * sqrt(252) AS sortino_ratio, avg(x) * 252 / max((pk - eq) / (pk + 1e-10)) AS calmar_ratio, 1 - stddev_pop(step) / (avg(eq) + 1e-10) AS equity_stability,
  count(*) FILTER (WHERE x > 0) / (count(*) + 1e-10) AS win_rate, sum(x) FILTER (WHERE x > 0) / sum(abs(x)) FILTER (WHERE x < 0) AS profit_factor FROM h GROUP BY 1)"""
BUN = ["cvar", "max_drawdown", "tail_loss_frequency", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "equity_stability", "win_rate", "profit_factor"]


def bundle(spark, sf):
    return stats.return_bundle(indexed(spark, sf).withColumn("x", c("r") / 50), ["model"], "x")


@query("return_metric_bundle", f"WITH {BUNDLE} SELECT model, n, {', '.join(r(x, x) for x in BUN)} FROM bun")
def return_bundle(spark, sf):
    return rounded(bundle(spark, sf))


@query("multi_objective_score", f"""WITH {BUNDLE} SELECT model, {r('0.15 * 0.6 - 0.20 * cvar - 0.20 * max_drawdown - 0.10 * tail_loss_frequency + 0.15 * sharpe_ratio + 0.10 * sortino_ratio + 0.10 * equity_stability', 'weighted_score')},
  {r('0.6 - 10 * cvar - 5 * max_drawdown', 'trial_score')} FROM bun""")
def objective(spark, sf):
    return rounded(stats.objective(bundle(spark, sf).withColumn("auc", F.lit(0.6))).select("model", "weighted_score", "trial_score"))


@query("risk_assessment_text", f"""WITH {BUNDLE}, t AS (SELECT model, concat_ws('; ', CASE WHEN max_drawdown > 0.15 THEN 'HIGH RISK: Max drawdown exceeds 15%. Consider reducing position sizes.' END,
  CASE WHEN cvar > 0.05 THEN 'ELEVATED TAIL RISK: CVaR > 5%. Consider tighter stop losses.' END, CASE WHEN sharpe_ratio < 1.0 THEN 'LOW RISK-ADJUSTED RETURN: Sharpe < 1.0. Review strategy parameters.' END) AS x FROM bun)
  SELECT model, CASE WHEN x = '' THEN 'System within acceptable risk parameters.' ELSE x END AS recommendations FROM t""")
def assessment(spark, sf):
    return decide.assessment(bundle(spark, sf)).select("model", "recommendations")


@query("decision_statistics", f"""WITH {INDEXED}, d AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'size_reduced' ELSE 'approved' END AS decision, sum(r) OVER (PARTITION BY model ORDER BY pos) AS cum, stddev_pop(r) OVER (PARTITION BY model) AS s,
   quantile_cont(-r, 0.95) OVER (PARTITION BY model) AS v FROM tr), f AS (SELECT *, max(cum) OVER (PARTITION BY model ORDER BY pos) AS top, min(cum) OVER (PARTITION BY model) AS lo FROM d)
  SELECT model, {r("avg(CASE WHEN decision = 'approved' THEN 1 ELSE 0 END)", 'approval_rate')}, {r("avg(CASE WHEN decision = 'rejected' THEN 1 ELSE 0 END)", 'rejection_rate')}, {r("avg(CASE WHEN decision = 'size_reduced' THEN 1 ELSE 0 END)", 'size_reduction_rate')},
   {r('avg(r)', 'mean_return')}, {r('abs(min((cum - top) / (top + 1e-10 + abs(lo))))', 'max_drawdown')}, {r('avg(-r) FILTER (WHERE -r >= v)', 'cvar_95')}, {r('avg(CASE WHEN r < -2 * s THEN 1 ELSE 0 END)', 'tail_loss_frequency')},
   {r('avg(r) / (max(s) + 1e-10) * sqrt(252)', 'sharpe_ratio')}, {r('1 / (1 + max(s) * 100)', 'equity_stability')} FROM f GROUP BY 1""")
def decision_statistics(spark, sf):
    k = c("pos") % 4
    d = indexed(spark, sf).withColumn("decision", F.when(k == 0, "rejected").when(k == 1, "size_reduced").otherwise("approved"))
    return rounded(stats.decision_statistics(d, ["model"]))


@query("volatility_percentile_regime", staged(HOURLY, BASE + [{"v": std("ret", 20)}, {"past": f"list(v) OVER ({W} ROWS BETWEEN 999 PRECEDING AND 1 PRECEDING)", "seen": f"count(v) {over(1000)}"},
    {"past2": "list_filter(past, lambda x: x IS NOT NULL)"}, {"pc": "(len(list_filter(past2, lambda x: x < v)) + len(list_filter(past2, lambda x: x <= v)) + CASE WHEN len(list_filter(past2, lambda x: x <= v)) > len(list_filter(past2, lambda x: x < v)) THEN 1 ELSE 0 END) * 0.5 / nullif(len(past2), 0)"},
    {"code": "CASE WHEN v IS NULL THEN NULL WHEN seen < 20 OR pc IS NULL THEN 1 WHEN pc < 0.25 THEN 0 WHEN pc < 0.5 THEN 1 WHEN pc < 0.75 THEN 2 ELSE 3 END"}], ["v", "code"]))
def vol_regime(spark, sf):
    s = Pieces(hourly(spark, sf), halo=1024)
    s.stage(_ret=s.pct("close"))
    s.stage(v=s.std("_ret", 20))
    s.stage(regime=stats.volatility_regime(s, "v"))
    code = F.when(c("regime") == "low", 0.0).when(c("regime") == "medium", 1.0).when(c("regime") == "high", 2.0).when(c("regime") == "extreme", 3.0)
    return rounded(s.close().select("symbol", "ts", "v", code.alias("code")))


@query("tail_event_labels", f"""WITH {TRADES}, q AS (SELECT *, quantile_cont(r, 0.05) OVER () AS p FROM trades) SELECT model, count(*) AS n, count(*) FILTER (WHERE r < -0.02 OR r < p) AS events FROM q GROUP BY 1""")
def tail_events(spark, sf):
    from marketspark.operators.features.labels import tail_event

    t = stats.with_quantile(trades(spark, sf), (), "r", 0.05, "p")
    return tail_event(t, "r", c("p")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("tail_event").alias("events"))


@query("drawdown_response_table", f"""WITH {TRADES}, q AS (SELECT quantile_cont(r, 0.05) AS v FROM trades), t AS (SELECT -avg(r) AS cvar FROM trades, q WHERE r <= v), m(k) AS (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0))
  SELECT k AS vol_multiple, {r('cvar * k', 'cvar')}, {r('least(1.0, 0.08 / greatest(0.01, cvar * k))', 'recommended_scale')} FROM t, m""")
def response_table(spark, sf):
    t = stats.return_tail(trades(spark, sf), (), "r").select((-c("cvar")).alias("b"), F.explode(F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0, 3.0)])).alias("vol_multiple"))
    t = t.withColumn("cvar", c("b") * c("vol_multiple"))
    return rounded(t.select("vol_multiple", "cvar", F.least(F.lit(1.0), 0.08 / F.greatest(F.lit(0.01), c("cvar"))).alias("recommended_scale")))


@query("drawdown_step_scale", f"WITH {STATES} SELECT account, pos, CASE WHEN dd < 0.05 THEN 1.0::DOUBLE WHEN dd < 0.10 THEN 0.75 WHEN dd < 0.15 THEN 0.5 WHEN dd < 0.20 THEN 0.25 ELSE 0.0 END AS scale FROM st")
def step_scale(spark, sf):
    return drawdown.equity_states(equity(spark, sf)).select("account", "pos", drawdown.step_scale(c("current_drawdown")).alias("scale"))


# ------------------------------------------------------------------ trade evaluation

PROPOSALS = """prop AS (SELECT o_orderkey, 'acc' || CAST(o_custkey % 3 AS VARCHAR) AS account, o_orderdate AS ts, CASE o_orderkey % 3 WHEN 0 THEN 'scalp' WHEN 1 THEN 'intraday' ELSE 'swing' END AS model,
  CASE WHEN o_orderkey % 11 = 0 THEN 'close' WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, 0.3 + (o_custkey % 61) / 100.0 AS probability, 0.3 + (o_orderkey % 67) / 100.0 AS confidence,
  (o_orderkey % 37) / 300.0 AS expected_return, 200.0 + o_custkey % 800 AS proposed_size, 0.01 + (o_orderkey % 3) / 100.0 AS stop_loss, 0.02 + (o_custkey % 4) / 100.0 AS take_profit,
  CASE o_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'extreme' END AS volatility_regime, 0.01 + (o_custkey % 5) / 100.0 AS current_volatility FROM orders)"""


def proposals(spark, sf):
    k, u = c("o_orderkey"), c("o_custkey")
    pick = lambda e, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (e + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("acc"), (u % 3).cast("string")).alias("account"), c("o_orderdate").alias("ts"), pick(k % 3, "scalp", "intraday", "swing").alias("model"),
        F.when(k % 11 == 0, "close").when(k % 2 == 0, "long").otherwise("short").alias("direction"), (0.3 + (u % 61) / 100.0).alias("probability"), (0.3 + (k % 67) / 100.0).alias("confidence"),
        ((k % 37) / 300.0).alias("expected_return"), (200.0 + u % 800).alias("proposed_size"), (0.01 + (k % 3) / 100.0).alias("stop_loss"), (0.02 + (u % 4) / 100.0).alias("take_profit"),
        pick(u % 4, "low", "normal", "high", "extreme").alias("volatility_regime"), (0.01 + (u % 5) / 100.0).alias("current_volatility"))


EVAL = STATES + ", " + PROPOSALS + f""", tail AS (SELECT model, n_samples, cvar, stress_cvar FROM ({'WITH ' + TAIL} SELECT * FROM s)),
 ev0 AS (SELECT p.*, coalesce(t.equity, 10000) AS equity, coalesce(t.risk_state, 'full_risk') AS risk_state, coalesce(t.risk_multiplier, 1) AS rm, coalesce(t.emergency, false) AS em,
   CASE p.model WHEN 'scalp' THEN coalesce(t.scalp_state, 'enabled') WHEN 'intraday' THEN coalesce(t.intraday_state, 'enabled') ELSE coalesce(t.swing_state, 'enabled') END AS ms
   FROM prop p ASOF LEFT JOIN st t ON p.account = t.account AND p.ts >= t.ts),
 ev1 AS (SELECT e.*, direction = 'close' OR expected_return < 0 AS closing, CASE ms WHEN 'enabled' THEN 1.0 WHEN 'reduced' THEN 0.5 ELSE 0 END * rm AS ddf, tail.cvar, tail.stress_cvar, CASE e.model WHEN 'scalp' THEN 0.05 WHEN 'intraday' THEN 0.07 ELSE 0.10 END AS lim,
   take_profit / stop_loss AS b, least(greatest(probability, 0.01), 0.99) AS p FROM ev0 e JOIN tail ON tail.model = e.model),
 ev2 AS (SELECT *, (p * b - (1 - p)) / b AS raw FROM ev1),
 ev3 AS (SELECT *, CASE WHEN p < 0.35 THEN raw * 0.5 ELSE raw END * 0.25 * CASE WHEN confidence >= 0.9 THEN 1 WHEN confidence >= 0.7 THEN 0.7 + (confidence - 0.7) * 1.5 WHEN confidence >= 0.5 THEN 0.4 + (confidence - 0.5) * 1.5 ELSE confidence * 0.8 END
   * least(greatest(0.02 / current_volatility, 0.3), 1.5) AS bet FROM ev2),
 ev4 AS (SELECT *, CASE WHEN raw <= 0 OR least(bet, 0.1) < 0.001 THEN 0 ELSE least(bet, 0.1) * equity END AS fs FROM ev3),
 ev5 AS (SELECT *, fs * ddf AS dds, least(fs * ddf * CASE volatility_regime WHEN 'low' THEN 1.2 WHEN 'normal' THEN 1.0 WHEN 'high' THEN 0.6 ELSE 0.3 END, CASE model WHEN 'scalp' THEN 10 WHEN 'intraday' THEN 5 ELSE 3 END * equity) AS fin FROM ev4),
 ev6 AS (SELECT *, CASE WHEN em THEN 'kill switch' WHEN risk_state = 'risk_off' AND NOT closing THEN 'risk-off' WHEN risk_state <> 'risk_off' AND ms = 'disabled' THEN 'model disabled' WHEN cvar > lim THEN 'cvar over limit'
   WHEN stress_cvar > lim * 1.5 THEN 'stress over limit' WHEN cvar > 0 AND expected_return / cvar < 0.5 THEN 'reward to risk too low' WHEN fs = 0 THEN 'no kelly size' WHEN dds = 0 THEN 'drawdown size zero' END AS why FROM ev5)"""


def evaluated(spark, sf):
    tails = stats.recent_tail_risk(trades(spark, sf), ["model"], "r", ORDER)
    return riskengine.evaluate(proposals(spark, sf), drawdown.equity_states(equity(spark, sf)), tails)


@query("trade_evaluation", f"""WITH {EVAL} SELECT o_orderkey, CASE WHEN why IS NOT NULL THEN 'rejected' WHEN fin >= proposed_size * 0.9 THEN 'approved' ELSE 'size_reduced' END AS decision, why AS reject_reason,
  {r('CASE WHEN why IS NULL THEN fin ELSE 0 END', 'approved_size', 1)}, {r('CASE WHEN why IS NULL THEN fin / equity ELSE 0 END', 'adjusted_leverage', 9)} FROM ev6""")
def trade_evaluation(spark, sf):
    return rounded(evaluated(spark, sf).select("o_orderkey", "decision", "reject_reason", "approved_size", "adjusted_leverage"), approved_size=1, adjusted_leverage=9)


@query("trade_admission", f"""WITH {EVAL} SELECT o_orderkey, ms AS model_state, CASE WHEN em THEN false WHEN risk_state = 'risk_off' THEN closing WHEN ms = 'disabled' THEN false ELSE true END AS dd_allowed,
  CASE WHEN em THEN 'emergency stop' WHEN risk_state = 'risk_off' AND NOT closing THEN 'risk-off' WHEN risk_state = 'risk_off' THEN 'risk-off trade allowed' WHEN ms = 'disabled' THEN 'model disabled' WHEN ms = 'reduced' THEN 'size limited' ELSE 'allowed' END AS dd_reason,
  {r('ddf', 'dd_factor')} FROM ev6""")
def trade_admission(spark, sf):
    a = riskengine.admission(riskengine.at_state(proposals(spark, sf), drawdown.equity_states(equity(spark, sf))))
    return rounded(a.select("o_orderkey", "model_state", "dd_allowed", "dd_reason", "dd_factor"))


@query("trade_decision_counters", f"""WITH {EVAL} SELECT account, count(*) AS total_decisions, count(*) FILTER (WHERE why IS NULL) AS approved, count(*) FILTER (WHERE why IS NOT NULL) AS rejected, {r('count(*) FILTER (WHERE why IS NULL) / count(*)', 'approval_rate')} FROM ev6 GROUP BY 1""")
def counters(spark, sf):
    return rounded(riskengine.decision_counters(evaluated(spark, sf)))


ENGINE = ENGINE_STATES + ", " + PROPOSALS.replace("WHEN 1 THEN 'normal'", "WHEN 1 THEN 'medium'") + f""", pay AS (SELECT model, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS w, avg(pnl) FILTER (WHERE pnl > 0) / abs(avg(pnl) FILTER (WHERE pnl < 0)) AS pr FROM trades GROUP BY 1),
 qq AS (SELECT quantile_cont(r / 5, 0.05) AS v FROM trades), pc AS (SELECT abs(avg(r / 5)) AS cv FROM trades, qq WHERE r / 5 <= v),
 g0 AS (SELECT p.*, coalesce(t.engine_state, 'ON') AS es, coalesce(t.dd_multiplier, 1) AS dm, CASE p.model WHEN 'scalp' THEN coalesce(t.scalp_disabled, false) WHEN 'intraday' THEN coalesce(t.intraday_disabled, false) ELSE false END AS dis FROM prop p ASOF LEFT JOIN es t ON p.account = t.account AND p.ts >= t.ts),
 g1 AS (SELECT g0.*, w, pr, cv, cv / 0.03 AS u, abs(expected_return) * (1 - confidence) * 0.1 AS impact FROM g0 JOIN pay ON pay.model = g0.model, pc),
 g2 AS (SELECT *, least(greatest(least(greatest(greatest(0, (w * pr - (1 - w)) / pr) * 0.25, 0.01), 0.5) * confidence * confidence * CASE volatility_regime WHEN 'low' THEN 1.2 WHEN 'medium' THEN 1.0 WHEN 'high' THEN 0.6 ELSE 0.2 END * CASE es WHEN 'ON' THEN 1.0 WHEN 'REDUCED' THEN 0.5 ELSE 0 END
   * CASE WHEN u > 0.5 THEN greatest(0, 1 - (u - 0.5) * 2) ELSE 1 END, 0.01), 0.5) AS k FROM g1),
 g3 AS (SELECT *, least(k * dm, 0.25) AS size, least(10 * confidence * CASE volatility_regime WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.8 WHEN 'high' THEN 0.5 ELSE 0.2 END * dm, 10) AS lev,
   CASE WHEN o_orderkey % 50 = 7 THEN 'Kill switch active - all trading halted' WHEN dis THEN 'model disabled' WHEN es = 'OFF' THEN 'risk off' WHEN cv + impact > 0.03 THEN 'CVaR exceeds threshold' WHEN impact > 0.015 THEN 'Trade CVaR impact too high' END AS why FROM g2)"""


@query("signal_evaluation_second_engine", f"""WITH {ENGINE} SELECT o_orderkey, CASE WHEN dis OR o_orderkey % 50 = 7 THEN 'vetoed' WHEN why IS NOT NULL THEN 'rejected' WHEN size < 0.001 THEN 'rejected' WHEN size < k * 0.5 THEN 'reduced' ELSE 'approved' END AS decision, why AS block_reason,
  {r('CASE WHEN why IS NULL THEN size ELSE 0 END', 'approved_size')}, {r('CASE WHEN why IS NULL THEN lev ELSE 0 END', 'approved_leverage')} FROM g3""")
def second_engine(spark, sf):
    p = proposals(spark, sf).withColumn("volatility_regime", F.when(c("volatility_regime") == "normal", "medium").otherwise(c("volatility_regime")))
    p = p.withColumn("halted", c("o_orderkey") % 50 == 7)  # the switch is on for every fiftieth proposal
    t = trades(spark, sf)
    cvar = stats.return_tail(t.withColumn("x", c("r") / 5), (), "x")
    out = riskengine.evaluate_signals(p, drawdown.engine_equity_states(equity(spark, sf)), stats.payoff(t, ["model"], "pnl"), cvar, halted="halted")
    return rounded(out.select("o_orderkey", "decision", "block_reason", "approved_size", "approved_leverage"))


@query("account_status_snapshot", f"""WITH {STATES}, tail AS (SELECT * FROM ({'WITH ' + TAIL} SELECT model, cvar, {LEVEL} AS lv FROM s)), pay2 AS (SELECT model, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS w, avg(pnl) FILTER (WHERE pnl > 0) / greatest(abs(avg(pnl) FILTER (WHERE pnl < 0)), 0.01) AS pr FROM trades GROUP BY 1),
  z AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY pos DESC) AS k FROM st), m AS ({' UNION ALL '.join(f"SELECT account, '{m}' AS model, {m}_state AS state, risk_state, emergency, equity, dd, max_drawdown, CAST(({' + '.join(f'''CAST({x}_state = 'enabled' AS INT)''' for x in MODELS)}) AS INTEGER) AS models_enabled FROM z WHERE k = 1" for m in MODELS)})
  SELECT account, m.model, state, risk_state, emergency AS kill_switch, equity, {r('dd', 'current_drawdown')}, {r('max_drawdown', 'max_drawdown')}, models_enabled, {r('cvar', 'cvar')}, lv AS cvar_risk_level, {r('w', 'win_rate')}, {r('pr', 'payoff_ratio')}, n AS n_trades FROM m JOIN tail USING (model) JOIN pay2 USING (model)""")
def snapshot(spark, sf):
    t = trades(spark, sf)
    s = riskengine.status_snapshot(drawdown.equity_states(equity(spark, sf)), stats.recent_tail_risk(t, ["model"], "r", ORDER), stats.payoff(t, ["model"], "pnl"))
    return rounded(s.select("account", "model", "state", "risk_state", "kill_switch", "equity", "current_drawdown", "max_drawdown", "models_enabled", "cvar", "cvar_risk_level", "win_rate", "payoff_ratio", "n_trades"))


@query("proposal_features", f"""WITH {PROPOSALS} SELECT o_orderkey, {', '.join(f"CAST(model = '{m}' AS INTEGER)::DOUBLE AS is_{m}" for m in MODELS)}, CAST(direction = 'long' AS INTEGER)::DOUBLE AS is_long,
  {', '.join(f"CAST(volatility_regime = '{v}' AS INTEGER)::DOUBLE AS vol_{v}" for v in ('low', 'normal', 'high'))} FROM prop""")
def proposal_features(spark, sf):
    return riskengine.proposal_features(proposals(spark, sf)).select("o_orderkey", *[f"is_{m}" for m in MODELS], "is_long", "vol_low", "vol_normal", "vol_high")
