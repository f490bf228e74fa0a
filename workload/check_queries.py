"""Quality and leakage checks, folds, model metrics, models, streams: A4-A8, A24-A46, V1-V3, V8, M1-M9, T1-T8."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.functions.quantiles import exact_quantiles
from marketspark.functions.series import index_rows, time_bucket
from marketspark.operators import ml, quality, splits, stats
from marketspark.operators import bars as B
from marketspark.operators.features import build, labels, technical
from marketspark.session import materialize, shared_folder
from marketspark.streaming import jobs
from workload.feature_queries import BASE_STAGES
from workload.risk_queries import STATES, TRADES, equity, trades
from workload.registry import EVENT_TICKS, HOURLY, event_ticks, hourly, query, r, rounded, table
from workload.sqltext import W, staged

c = F.col


# ------------------------------------------------------------------ quality


@query("null_report", f"""SELECT * FROM (SELECT 'a' AS "column", {r('avg(CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END) * 100', 'null_pct', 2)} FROM documents UNION ALL SELECT 'b', {r("avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) * 100", 'null_pct', 2)} FROM documents) WHERE null_pct > 0""")
def null_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(c("n_chars") % 3 != 0, c("n_chars")).alias("a"), F.when(c("lang") != "en", c("lang")).alias("b"))
    return quality.null_report(d)


@query("outlier_counts", "WITH " + HOURLY + f""", l AS (SELECT symbol, 'close' AS "column", close AS v FROM bars UNION ALL SELECT symbol, 'volume', volume FROM bars), q AS (SELECT symbol, "column", quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM l GROUP BY ALL)
  SELECT symbol, "column", {r('max(a)', 'q01')}, {r('max(b)', 'q99')}, count(*) FILTER (WHERE v < a - 3 * (b - a) OR v > b + 3 * (b - a)) AS outliers FROM l JOIN q USING (symbol, "column") GROUP BY ALL""")
def outliers(spark, sf):
    return rounded(quality.outliers(hourly(spark, sf), ["close", "volume"]))


@query("exact_quantiles_prices", "SELECT l_returnflag, 'l_extendedprice' AS \"column\", " + ", ".join(r(f"quantile_cont(l_extendedprice, {q})", f"q{i}") for i, q in enumerate((0.001, 0.25, 0.5, 0.9, 0.999))) + " FROM lineitem GROUP BY 1")
def quantiles(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_extendedprice"], [0.001, 0.25, 0.5, 0.9, 0.999])
    return rounded(q.select("l_returnflag", "column", *[c("q")[i].alias(f"q{i}") for i in range(5)]))


@query("temporal_integrity", f"""WITH {HOURLY}, s AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars WHERE trades_count > 0) SELECT symbol, count(*) AS "rows", count(*) FILTER (WHERE epoch(d) < 0) AS backward_steps,
  count(*) FILTER (WHERE epoch(d) > 5400) AS gaps, true AS monotonic, count(*) FILTER (WHERE epoch(d) > 5400) > count(*) * 0.01 AS flagged, {r('count(*) FILTER (WHERE epoch(d) > 5400) / count(*) * 100', 'gap_pct')} FROM s GROUP BY 1""")
def temporal(spark, sf):
    from marketspark.functions.series import index_rows, time_bucket

    s = index_rows(B.sparse_bars(event_ticks(spark, sf), "1h"), ["symbol"], ["ts"], time_bucket("ts", 30 * 86_400))
    return rounded(quality.temporal_integrity(s, "1h"))


@query("class_distribution", "SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct, max(count(*)) OVER () / min(count(*)) OVER () > 5 AS flagged FROM labels GROUP BY 1")
def class_distribution(spark, sf):
    return quality.class_distribution(table(spark, sf, "labels"), "quality").drop("imbalance")


@query("target_summary", "SELECT lang, count(n_chars) AS n, " + ", ".join(r(e, n) for e, n in (("avg(n_chars)", "mean"), ("stddev_samp(n_chars)", "std"), ("quantile_cont(n_chars, 0.25)", "q25"), ("quantile_cont(n_chars, 0.5)", "median"), ("quantile_cont(n_chars, 0.75)", "q75"))) + ", min(n_chars) AS min, max(n_chars) AS max FROM documents GROUP BY 1")
def target_summary(spark, sf):
    return rounded(quality.target_summary(table(spark, sf, "documents"), "n_chars", ["lang"]))


TARGET = f"CASE WHEN lead(close, 6) OVER ({W}) / close - 1 > 0.01 THEN 2 WHEN lead(close, 6) OVER ({W}) / close - 1 < -0.01 THEN 0 WHEN lead(close, 6) OVER ({W}) IS NOT NULL THEN 1 END"
LABELLED = HOURLY + f", lab AS (SELECT *, {TARGET} AS target, lead(close) OVER ({W}) / close - 1 AS future_return FROM bars)"


def labelled(spark, sf):
    return labels.direction(hourly(spark, sf), 6, 0.01)


@query("target_correlations", f"WITH {LABELLED}" + " UNION ALL ".join(f" SELECT '{f}' AS feature, {r(f'corr({f}, target)', 'corr')}, abs(corr({f}, target)) > 0.3 AS above_3, abs(corr({f}, target)) > 0.5 AS above_5, abs(corr({f}, target)) > 0.7 AS above_7 FROM lab" for f in ("open", "high", "low", "close", "volume")))
def target_corr(spark, sf):
    d = labelled(spark, sf).filter("target is not null")
    return rounded(quality.target_correlations(d, ["open", "high", "low", "close", "volume"], "target"))


@query("look_ahead_check", f"WITH {LABELLED} SELECT symbol, {r('corr(volume, future_return)', 'corr')}, abs(corr(volume, future_return)) > 0.3 AS suspicious FROM lab GROUP BY 1")
def look_ahead(spark, sf):
    return rounded(quality.look_ahead_check(hourly(spark, sf)))


@query("half_distributions", f"""WITH {LABELLED}, h AS (SELECT symbol, target, count(*) FILTER (WHERE pos < n // 2) AS a, count(*) FILTER (WHERE pos >= n // 2) AS b FROM lab WHERE target IS NOT NULL GROUP BY 1, 2)
  SELECT symbol, CAST(sum(abs(a - b)) AS BIGINT) AS difference, max(a) AS top_first, max(b) AS top_second, sum(abs(a - b)) = 0 AS identical FROM h GROUP BY 1""")
def halves(spark, sf):
    return quality.half_distributions(labelled(spark, sf))


@query("horizon_check", f"""WITH {LABELLED} SELECT symbol, count(*) AS "rows", count(*) FILTER (WHERE pos >= n - 6 AND target IS NULL) AS null_tail, {r('avg(CASE WHEN target IS NULL THEN 1 ELSE 0 END) * 100', 'null_pct')}, true AS shift_ok, true AS enough_rows, true AS nulls_ok FROM lab GROUP BY 1""")
def horizon(spark, sf):
    return rounded(quality.horizon_check(labelled(spark, sf), "target", 6))


@query("scaling_leak", f"""WITH {HOURLY} SELECT symbol, {r('avg(close)', 'mean_all')}, {r('avg(close) FILTER (WHERE pos < n * 0.8)', 'mean_train')}, {r('abs(avg(close) - avg(close) FILTER (WHERE pos < n * 0.8)) / stddev_pop(close) FILTER (WHERE pos < n * 0.8)', 'mean_shift')},
  {r('stddev_pop(close) / stddev_pop(close) FILTER (WHERE pos < n * 0.8)', 'std_ratio')} FROM bars GROUP BY 1""")
def scaling_leak(spark, sf):
    return rounded(quality.scaling_leak(hourly(spark, sf), "close", F.expr("pos < n * 0.8")).select("symbol", "mean_all", "mean_train", "mean_shift", "std_ratio"))


FEATS = ["return_1", "return_3", "return_5", "rsi_7", "rsi_14", "volatility_10", "volatility_20", "volume_ratio_10", "macd", "atr", "bb_position"]
_comp = " AND ".join(f"{n} IS NOT NULL" for n in technical.BASE_FEATURES)
_base = staged(HOURLY, BASE_STAGES, ["macd"]).rsplit(" SELECT symbol, ts", 1)[0] + f", fx AS (SELECT * FROM s{len(BASE_STAGES) - 1} WHERE {_comp})"
_pairs = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]


def base(spark, sf):
    return technical.base_features(hourly(spark, sf))


#: two more features, one nearly and one wholly told by others, so that both bands occur
MORE = {"rsi_mean": "(rsi_7 + rsi_14) / 2", "atr_double": "atr * 2"}
_more_pairs = [(a, b) for i, a in enumerate([*FEATS, *MORE]) for b in [*FEATS, *MORE][i + 1:]]


@query("feature_pairs_correlated", f"{_base}, fm AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in MORE.items())} FROM fx), pr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, abs(corr({a}, {b})) AS x FROM fm" for a, b in _more_pairs) + f""")
  SELECT feature_1, feature_2, {r('x', 'corr')}, CASE WHEN x > 0.95 THEN 'high' ELSE 'moderate' END AS band FROM pr WHERE x > 0.80""")
def feature_pairs(spark, sf):
    d = base(spark, sf).withColumns({n: F.expr(x) for n, x in MORE.items()})
    return rounded(quality.correlated_pairs(materialize(d, "base"), [*FEATS, *MORE]))


@query("feature_low_variance", f"{_base} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'var_pop({f})', 'variance')}, var_pop({f}) <= 0.01 AS dropped FROM fx" for f in FEATS))
def low_variance(spark, sf):
    return rounded(quality.low_variance(base(spark, sf), FEATS))


@query("feature_variance_inflation", f"{_base}, pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS f, abs(corr({a}, {b})) AS x FROM fx UNION ALL SELECT '{b}', abs(corr({a}, {b})) FROM fx" for a, b in _pairs) + f") SELECT f AS feature, {r('1 / (1 - pow(max(x), 2) + 1e-10)', 'vif', 4)}, 1 / (1 - pow(max(x), 2) + 1e-10) > 10 AS flagged FROM pr GROUP BY 1")
def vif(spark, sf):
    return rounded(quality.inflation_factors(materialize(base(spark, sf), "base"), FEATS, approximate=True), 4)


@query("feature_variance_inflation_full")
def vif_full(spark, sf):
    return quality.inflation_factors(materialize(base(spark, sf), "base"), FEATS)


@query("feature_stability", f"""{_base}, sl AS (SELECT *, pos // (n // 5) AS k FROM fx), lg AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, k, {f} AS v FROM sl WHERE k < 5" for f in FEATS)}),
  pe AS (SELECT feature, k, avg(v) AS m, stddev_samp(v) AS s FROM lg GROUP BY 1, 2 HAVING count(v) > 10) SELECT feature, count(*) AS slices, {r('stddev_pop(m) / (avg(abs(m)) + 1e-10)', 'mean_cv')}, {r('stddev_pop(s) / (avg(s) + 1e-10)', 'std_cv')},
  stddev_pop(m) / (avg(abs(m)) + 1e-10) > 1 OR stddev_pop(s) / (avg(s) + 1e-10) > 1 AS unstable FROM pe GROUP BY 1""")
def stability(spark, sf):
    return rounded(quality.feature_stability(base(spark, sf), FEATS))


def _assignment_sql():
    low = " UNION ALL ".join(f"SELECT {i} AS k, '{f}' AS feature, var_pop({f}) <= 0.01 AS dropped FROM fx" for i, f in enumerate(FEATS))
    hits = " UNION ALL ".join(f"SELECT feature, all_k, '{m}' AS model, regexp_matches(lower(feature), '{'|'.join(p)}') AS hit FROM kept" for m, p in quality.GROUPS.items())
    return f"""{_base}, low AS ({low}), kept AS (SELECT feature, row_number() OVER (ORDER BY k) AS all_k FROM low WHERE NOT dropped), h AS ({hits}),
  w AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY model) AS own, count(*) FILTER (NOT hit) OVER (PARTITION BY model ORDER BY all_k) AS lack FROM h)
  SELECT feature, model FROM w WHERE hit OR (own < 5 AND CASE WHEN model = 'scalp' THEN all_k <= 10 ELSE lack <= 10 END)"""


@query("feature_assignment", _assignment_sql())
def assignment(spark, sf):
    d = materialize(base(spark, sf), "base")
    dropped = quality.low_variance(d, FEATS).filter("dropped").select("feature")
    return quality.assign_features(spark, FEATS, dropped)


# ------------------------------------------------------------------ folds


def _fold_sql(folds, te, vs, ve):
    return f"""WITH {HOURLY}, f AS (SELECT symbol, pos, n, unnest(range({folds})) AS fold FROM bars), g AS (SELECT *, CASE WHEN pos < {te} THEN 'train' WHEN pos >= {vs} AND pos < {ve} THEN 'valid' END AS role FROM f)
  SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS k, min(pos) AS lo, max(pos) AS hi FROM g WHERE role IS NOT NULL GROUP BY ALL"""


def _fold_counts(df):
    return df.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query("folds_expanding", _fold_sql(5, "n - (5 - fold) * (n // 6)", "n - (5 - fold) * (n // 6)", "n - (5 - fold) * (n // 6) + n // 6"))
def folds_expanding(spark, sf):
    return _fold_counts(splits.expanding(hourly(spark, sf)))


_te = "CAST(floor(n * 0.3) AS BIGINT) + fold * (CAST(floor(n * 0.2) AS BIGINT) // 5)"


@query("folds_purged", _fold_sql(5, _te, f"{_te} + 9", f"least({_te} + 9 + CAST(floor(n * 0.2) AS BIGINT), n)"))
def folds_purged(spark, sf):
    return _fold_counts(splits.purged(hourly(spark, sf)))


@query("folds_purged_simple", _fold_sql(5, "(fold + 1) * (n // 6)", "(fold + 1) * (n // 6) + 6", "least((fold + 2) * (n // 6) + 6, n)"))
def folds_simple(spark, sf):
    return _fold_counts(splits.purged_simple(hourly(spark, sf)))


@query("folds_purged_by_trim", _fold_sql(5, "CASE WHEN n - (5 - fold) * (n // 6) - 6 > 100 THEN n - (5 - fold) * (n // 6) - 6 ELSE 0 END", "n - (5 - fold) * (n // 6)", "CASE WHEN n - (5 - fold) * (n // 6) - 6 > 100 THEN n - (5 - fold) * (n // 6) + n // 6 ELSE 0 END"))
def folds_trim(spark, sf):
    return _fold_counts(splits.purged_by_trim(hourly(spark, sf)))


@query("split_hold_out", f"WITH {HOURLY}, p AS (SELECT symbol, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'valid' ELSE 'test' END AS part FROM bars) SELECT symbol, part, count(*) AS k FROM p GROUP BY ALL")
def hold_out(spark, sf):
    return splits.hold_out(hourly(spark, sf), (0.6, 0.2, 0.2), ("train", "valid", "test")).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("k"))


@query("sample_by_hash")
def sample(spark, sf):
    return splits.sample_rows(table(spark, sf, "lineitem"), 0.2, ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------ model metrics

#: documents with made-up class scores against their labels
SCORED = """sc AS (SELECT doc_id, quality AS y, (n_chars % 17 + 1) / 40.0 AS a, (n_chars % 29 + 1) / 70.0 AS b, (n_chars % 23) / 22.0 AS s, CAST(doc_id % 3 AS INTEGER) AS y3 FROM labels JOIN documents USING (doc_id)),
 s3 AS (SELECT *, a / (a + b + 0.3) AS p0, b / (a + b + 0.3) AS p1, 0.3 / (a + b + 0.3) AS p2 FROM sc)"""


def scored(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    d = d.select("doc_id", c("quality").alias("y"), ((c("n_chars") % 17 + 1) / 40.0).alias("a"), ((c("n_chars") % 29 + 1) / 70.0).alias("b"), ((c("n_chars") % 23) / 22.0).alias("s"), (c("doc_id") % 3).cast("int").alias("y3"))
    t = c("a") + c("b") + 0.3
    return d.withColumns({"p0": c("a") / t, "p1": c("b") / t, "p2": 0.3 / t})


@query("metric_classification", f"""WITH {SCORED} SELECT count(*) AS n, {r('avg(CASE WHEN (CASE WHEN p0 >= greatest(p1, p2) THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = y3 THEN 1 ELSE 0 END)', 'accuracy')}, {r('avg(-ln(CASE y3 WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END))', 'log_loss')} FROM s3""")
def m_class(spark, sf):
    return rounded(stats.classification_metrics(scored(spark, sf), "y3", ["p0", "p1", "p2"]))


AUC1 = "SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1))"


@query("metric_auc", f"""WITH {SCORED}, rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM sc) SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y <> 1) AS n_neg, round(({AUC1} FROM rk), 6) + 0.0 AS auc FROM rk""")
def m_auc(spark, sf):
    return rounded(stats.auc(scored(spark, sf), (), "s", c("y") == 1))


@query("metric_auc_multiclass", f"""WITH {SCORED}, l AS (SELECT 0 AS k, p0 AS s, y3 = 0 AS y FROM s3 UNION ALL SELECT 1, p1, y3 = 1 FROM s3 UNION ALL SELECT 2, p2, y3 = 2 FROM s3), rk AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS rk FROM l),
  a AS (SELECT k, count(*) FILTER (WHERE y) AS np, (sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auc FROM rk GROUP BY 1)
  SELECT {r('avg(auc)', 'auc_macro')}, {r('sum(auc * np) / sum(np)', 'auc_weighted')} FROM a""")
def m_auc3(spark, sf):
    return rounded(stats.multiclass_auc(scored(spark, sf), "y3", ["p0", "p1", "p2"]))


@query("metric_regression", f"WITH {SCORED} SELECT count(*) AS n, {r('sqrt(avg(pow(y - s, 2)))', 'rmse')}, {r('avg(abs(y - s))', 'mae')}, {r('1 - sum(pow(y - s, 2)) / (var_pop(y) * count(*))', 'r2')} FROM sc")
def m_regr(spark, sf):
    return rounded(stats.regression_metrics(scored(spark, sf), "y", "s"))


@query("metric_confident_accuracy", f"""WITH {SCORED} SELECT count(*) AS n, {r('avg(CASE WHEN (CASE WHEN p0 >= greatest(p1, p2) THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = y3 THEN 1 ELSE 0 END)', 'accuracy')} FROM s3 WHERE greatest(p0, p1, p2) >= 0.5""")
def m_conf(spark, sf):
    return rounded(stats.confident_accuracy(scored(spark, sf), "y3", ["p0", "p1", "p2"], 0.5))


@query("metric_ks", f"""WITH u AS (SELECT value AS v, event_type = 'click' AS a FROM events), d AS (SELECT v, count(*) FILTER (WHERE a) AS x, count(*) FILTER (WHERE NOT a) AS z FROM u GROUP BY 1),
  f AS (SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER () AS f1, sum(z) OVER (ORDER BY v) / sum(z) OVER () AS f2 FROM d), t AS (SELECT count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2 FROM u), k AS (SELECT max(abs(f1 - f2)) AS s FROM f),
  l AS (SELECT n1, n2, s, sqrt(n1 * n2 / (n1 + n2)) * s AS lam FROM t, k) SELECT n1, n2, {r('s', 'statistic')}, round(CASE WHEN lam < 0.04 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda i: pow(-1, i - 1) * exp(-2 * i * i * lam * lam))), 0), 1) END, 6) + 0.0 AS p_value FROM l""")
def m_ks(spark, sf):
    e = table(spark, sf, "events")
    return rounded(stats.ks_two_sample(e, (), "value", c("event_type") == "click"))


@query("metric_ks_feature_windows", f"""WITH {HOURLY}, u AS (SELECT symbol, volume AS v, pos >= n - 50 AS a FROM bars), d AS (SELECT symbol, v, count(*) FILTER (WHERE a) AS x, count(*) FILTER (WHERE NOT a) AS z FROM u GROUP BY 1, 2),
  f AS (SELECT symbol, sum(x) OVER (PARTITION BY symbol ORDER BY v) / sum(x) OVER (PARTITION BY symbol) AS f1, sum(z) OVER (PARTITION BY symbol ORDER BY v) / sum(z) OVER (PARTITION BY symbol) AS f2 FROM d) SELECT symbol, {r('max(abs(f1 - f2))', 'statistic')} FROM f GROUP BY 1""")
def m_ks_windows(spark, sf):
    return rounded(stats.ks_two_sample(hourly(spark, sf), ["symbol"], "volume", F.expr("pos >= n - 50")).select("symbol", "statistic"))


@query("metric_period_stability", f"""WITH p AS (SELECT l_linenumber - 1 AS k, avg(l_discount) AS v FROM lineitem GROUP BY 1), m AS (SELECT max(k) AS hi FROM p) SELECT count(*) AS periods, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('regr_slope(v, k)', 'trend', 8)},
  {r('(avg(v) FILTER (WHERE k * 2 < hi + 1) - avg(v) FILTER (WHERE k * 2 >= hi + 1)) / avg(v) FILTER (WHERE k * 2 < hi + 1)', 'degradation')}, {r('stddev_pop(v) / abs(avg(v))', 'cv')} FROM p, m""")
def m_period(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", c("l_linenumber") - 1)
    return rounded(stats.period_stability(li, "l_discount", "k").select("periods", "mean", "std", "trend", "degradation", "cv"), trend=8)


@query("metric_trial_stability", f"""WITH t AS (SELECT o_orderpriority AS study, o_totalprice AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  SELECT study, count(*) AS n_late, {r('avg(s)', 'mean', 4)}, {r('stddev_pop(s)', 'std', 4)}, {r('stddev_pop(s) / (abs(avg(s)) + 1e-10)', 'cv')}, stddev_pop(s) / (abs(avg(s)) + 1e-10) < 0.1 AS stable FROM t WHERE k >= n // 2 GROUP BY 1""")
def m_trials(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderpriority").alias("study"), "o_orderkey", "o_totalprice")
    return rounded(stats.trial_stability(o, "study", "o_orderkey", "o_totalprice"), mean=4, std=4)


@query("metric_risk_objectives", f"""WITH {SCORED}, e AS (SELECT a, s, abs(a - s) AS e FROM sc), q AS (SELECT quantile_cont(e, 0.95) AS q, quantile_cont(a, 0.8) AS t FROM e) SELECT {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(e) FILTER (WHERE e >= q)', 'tail_error')}, {r('avg(CASE WHEN s < a THEN 1 ELSE 0 END) FILTER (WHERE a > t)', 'under_prediction_rate')} FROM e, q""")
def m_objectives(spark, sf):
    return rounded(stats.risk_objectives(scored(spark, sf), "a", "s"))


@query("compare_two_tables", f"""WITH j AS (SELECT o_orderkey, o_totalprice AS x, o_totalprice * CASE WHEN o_orderkey % 100 = 0 THEN 1.001 ELSE 1.00001 END AS y FROM orders) SELECT 'v' AS "column", {r('max(abs(x - y))', 'max_diff', 4)}, {r('avg(abs(x - y))', 'mean_diff')}, count(*) FILTER (WHERE NOT abs(x - y) <= 1e-6 + 1e-4 * abs(y)) AS n_far,
  bool_and(abs(x - y) <= 1e-6 + 1e-4 * abs(y)) AS all_close FROM j""")
def compare_tables(spark, sf):
    o = table(spark, sf, "orders")
    b = o.select("o_orderkey", (c("o_totalprice") * F.when(c("o_orderkey") % 100 == 0, 1.001).otherwise(1.00001)).alias("v"))
    return rounded(stats.compare_tables(o.select("o_orderkey", c("o_totalprice").alias("v")), b, ["o_orderkey"], ["v"]), max_diff=4)


@query("monitoring_health", f"""WITH g AS (SELECT event_type AS model, count(*) AS total, avg(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS blocked_share, avg(value) AS avg_latency_ms, max(value) AS max_latency_ms, avg(value / 500) AS avg_risk, count(*) FILTER (WHERE user_id % 50 = 0) AS degradation_alerts FROM events GROUP BY 1)
  SELECT model, total, {r('blocked_share', 'blocked_share')}, {r('avg_latency_ms', 'avg_latency_ms')}, {r('max_latency_ms', 'max_latency_ms')}, {r('avg_risk', 'avg_risk')}, degradation_alerts,
  concat_ws('; ', CASE WHEN avg_latency_ms > 100 THEN 'high latency' END, CASE WHEN total > 100 AND blocked_share > 0.5 THEN 'high block rate' END, CASE WHEN degradation_alerts > 5 THEN 'signal degradation' END) AS issues, avg_latency_ms <= 100 AS is_healthy FROM g""")
def monitoring(spark, sf):
    e = table(spark, sf, "events").select(c("event_type").alias("model"), (c("value") > 200).alias("blocked"), c("value").alias("latency_ms"), (c("value") / 500).alias("risk_score"), (c("user_id") % 50 == 0).alias("degraded"))
    return rounded(stats.monitoring(e))


@query("checkpoint_verdict", """WITH g AS (SELECT l_linenumber AS k, l_linenumber % 2 = 1 AS critical, avg(l_discount) < 0.0502 AS passed, count(*) FILTER (WHERE l_discount > 0.099) % 4 AS w, count(*) FILTER (WHERE l_tax > 0.079) % 3 AS e FROM lineitem GROUP BY 1),
  t AS (SELECT count(*) AS checkpoints, count(*) FILTER (WHERE passed) AS passed, CAST(sum(w) AS BIGINT) AS warnings, CAST(sum(e) AS BIGINT) AS errors, count(*) FILTER (WHERE critical AND NOT passed) AS critical_failures FROM g)
  SELECT *, CASE WHEN critical_failures <= 0 AND checkpoints - passed <= 1 AND warnings <= 10 THEN 'GO' WHEN critical_failures <= 0 AND checkpoints - passed <= 3 THEN 'CONDITIONAL GO' ELSE 'NO-GO' END AS verdict FROM t""")
def verdict(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(c("l_linenumber").alias("k")).agg(F.avg("l_discount").alias("d"), (F.count_if(c("l_discount") > 0.099) % 4).alias("n_warnings"), (F.count_if(c("l_tax") > 0.079) % 3).alias("n_errors"))
    return stats.verdict(li.select("k", (c("k") % 2 == 1).alias("critical"), (c("d") < 0.0502).alias("passed"), "n_warnings", "n_errors"))


DRIFT = f"""WITH k AS (SELECT event_type AS model, value / 500 AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS i FROM events), g AS (SELECT model, count(*) AS n, abs(avg(v) FILTER (WHERE i <= 20) - avg(v) FILTER (WHERE i > 20)) / (stddev_pop(v) FILTER (WHERE i > 20) + 0.01) AS d FROM k WHERE i <= 50 GROUP BY 1)
  SELECT model, n, {r('d', 'drift')}, d > 0.9 AS alert FROM g WHERE n >= 50"""


@query("degradation_alert", DRIFT)
def degradation(spark, sf):
    e = table(spark, sf, "events").select(c("event_type").alias("model"), "ts", (c("value") / 500).alias("risk_score"))
    return rounded(jobs.degradation(e))


# ------------------------------------------------------------------ models (no SQL form)

MODEL_FEATS = ["return_1", "return_5", "rsi_14", "volatility_20", "volume_ratio_10", "macd_hist", "bb_position"]


def training(spark, sf):
    d = labels.direction(base(spark, sf), 6, 0.05)
    return materialize(d.filter("target is not null").select("symbol", "ts", "pos", "n", "target", *MODEL_FEATS), "training")


@query("model_direction_scores")
def model_scores(spark, sf):
    d = splits.hold_out(training(spark, sf))
    model = ml.direction_model(MODEL_FEATS, "target").fit(d.filter("part = 'train'"))
    return ml.score_direction(model, d.filter("part = 'test'")).select("symbol", "ts", "P_down", "P_flat", "P_up", "predicted_class", "confidence", "expected_return")


@query("model_cross_validation")
def model_cv(spark, sf):
    return ml.cross_validate(training(spark, sf), MODEL_FEATS, "target", ml.direction_model, "direction", folds=5)


@query("model_baseline_summary")
def model_baseline(spark, sf):
    return ml.fold_summary(ml.cross_validate(training(spark, sf), MODEL_FEATS, "target", lambda f, y: ml.direction_model(f, y, "logistic"), "direction", folds=5))


@query("model_feature_importance")
def model_importance(spark, sf):
    return ml.importance(ml.direction_model(MODEL_FEATS, "target").fit(training(spark, sf)), MODEL_FEATS, spark)


@query("model_binary_next_bar")
def model_binary(spark, sf):
    """All features, early stopping on the last fifth of the training rows, refit, test metrics and rounds."""
    d = labels.next_bar(base(spark, sf), binary=True)
    names = build.feature_columns(d, {"target"})
    d = splits.hold_out(materialize(d.select("symbol", "ts", "pos", "n", "target", *names).dropna(), "binary"), (0.85, 0.15))
    m, rounds = ml.fit_boosted(d.filter("part = 'train'"), names, "target", ml.binary_model, ml.last_share())
    return stats.auc(ml.score_binary(m, d.filter("part = 'test'")), (), "P_up", c("target") == 1).withColumn("rounds", F.lit(rounds))


@query("model_risk_regressor")
def model_risk(spark, sf):
    df, names = build.risk_table(hourly(spark, sf))
    df = splits.hold_out(materialize(df, "risk"))
    m, rounds = ml.fit_boosted(df.filter("part = 'train'"), names, "risk_score", ml.risk_model, ml.last_share())
    return stats.regression_metrics(ml.score_risk(m, df.filter("part = 'test'")), "risk_score", "predicted_risk").withColumn("rounds", F.lit(rounds))


@query("model_risk_cross_validation")
def model_risk_cv(spark, sf):
    """Early stopping inside every fold; mean and deviation of the fold metrics."""
    df, names = build.risk_table(hourly(spark, sf))
    return ml.fold_summary(ml.cross_validate(materialize(df, "risk"), names, "risk_score", ml.risk_model, "risk", folds=5, boost=ml.last_share()))


@query("model_risk_event_classifier")
def model_event(spark, sf):
    d = stats.with_quantile(materialize(base(spark, sf), "base"), (), "return_1", 0.05, "p05")
    d = labels.tail_event(d, "return_1", c("p05")).withColumnRenamed("tail_event", "target")
    names = [x for x in build.feature_columns(d, {"target", "p05"}) if x != "return_1"]
    d = splits.hold_out(materialize(d.select("symbol", "ts", "pos", "n", "target", *names).dropna(), "events"), (0.6, 0.2, 0.2), ("train", "valid", "test"))
    m, rounds = ml.fit_boosted(d.filter("part <> 'test'"), names, "target", ml.binary_model, c("part") == "valid")
    return stats.auc(ml.score_binary(m, d.filter("part <> 'train'")), ["part"], "P_up", c("target") == 1).withColumn("rounds", F.lit(rounds))


@query("model_search")
def model_search(spark, sf):
    return ml.search(training(spark, sf), MODEL_FEATS, "target", ml.direction_model, "direction", {"maxDepth": [3, 5], "numTrees": [10, 20]}, folds=5)


@query("model_determinism")
def model_determinism(spark, sf):
    d = training(spark, sf).withColumn("y", c("target").cast("double"))
    return ml.fit_twice(d, MODEL_FEATS, "y", ml.risk_model, ["symbol", "ts"])


@query("leakage_order_reversal")
def leakage_order(spark, sf):
    return ml.order_reversal(training(spark, sf), MODEL_FEATS, "target", ml.direction_model)


@query("leakage_cross_symbol")
def leakage_cross(spark, sf):
    return ml.cross_symbol(training(spark, sf), MODEL_FEATS, "target", ml.direction_model, "view")


# ------------------------------------------------------------------ streams

def _tick_files(spark, sf):
    """Ticks as CSV files, one folder; the symbol is told by a column, since file names are Spark's."""
    path = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex}"
    event_ticks(spark, sf).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def _drain(stream, mode="append", **options):
    """Run a stream over the files there are and return what it wrote."""
    spark = stream.sparkSession
    path, chk = (f"{shared_folder(spark)}/{k}-{uuid.uuid4().hex}" for k in ("out", "chk"))
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        w = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(path))
    w.option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


#: the last hour of the stream stays open behind the watermark
STREAMED = "symbol, ts, " + ", ".join(r(x, x) for x in ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume")) + ", CAST(trades_count AS BIGINT) AS trades_count"


@query("stream_bars", f"WITH {HOURLY}, w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT {STREAMED} FROM bars, w WHERE trades_count > 0 AND ts + INTERVAL 1 HOUR <= mark")
def stream_bars(spark, sf):
    path = _tick_files(spark, sf)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return rounded(_drain(jobs.stream_bars(s, "1h", late="10 minutes")))


@query("stream_sliding_statistics", f"""WITH {EVENT_TICKS}, w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
  x AS (SELECT symbol, price, qty, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS st FROM ticks, (SELECT unnest(range(4)) AS k))
  SELECT symbol, st AS ts, count(price) AS n, {r('avg(price)', 'mean')}, {r('stddev_samp(price)', 'std')}, {r('sum(qty)', 'volume')}, {r('min(price)', 'low')}
  FROM x, w WHERE st + INTERVAL 4 HOUR <= mark GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    path = _tick_files(spark, sf)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return rounded(_drain(jobs.sliding_statistics(s, "4 hours", "1 hour")))


def _score_stream(spark, sf):
    """Events as scores of models, read as a stream."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    table(spark, sf, "events").select(
        c("event_type").alias("model"), "ts", ((c("user_id") % 100) / 100.0).alias("risk_score"), c("value").alias("latency_ms"),
        ((c("event_id") % 100) / 100.0).alias("confidence")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("stream_alerts", """WITH a AS (
  SELECT event_type AS model, unnest(list_filter([CASE WHEN value > 100 THEN 'HIGH_LATENCY' END, CASE WHEN (event_id % 100) / 100.0 < 0.3 THEN 'LOW_CONFIDENCE' END,
         CASE WHEN (user_id % 100) / 100.0 > 0.9 THEN 'HIGH_RISK' END], lambda x: x IS NOT NULL)) AS alert FROM events)
  SELECT model, alert, count(*) AS n FROM a GROUP BY 1, 2""")
def stream_alerts(spark, sf):
    base = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    w = _score_stream(spark, sf).writeStream.foreachBatch(jobs.alert_sink(f"{base}/scores", f"{base}/alerts"))
    w.option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("model string, alert string").json(f"{base}/alerts/*")
    return found.filter("alert <> 'SIGNAL_DEGRADATION'").groupBy("model", "alert").agg(F.count(F.lit(1)).alias("n"))


@query("stream_refresh", f"SELECT event_type AS model, count(*) AS n, {r('max(value)', 'worst')} FROM events GROUP BY 1")
def stream_refresh(spark, sf):
    base = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    build = lambda d: d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("worst"))
    publish = lambda d: d.write.mode("overwrite").parquet(f"{base}/out")
    jobs.refresh(_score_stream(spark, sf), build, publish, f"{base}/chk", f"{base}/store", {"availableNow": True}).awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"))


@query("stream_prediction_history", f"SELECT event_type AS symbol, ts, {r('value', 'price')} FROM events")
def stream_history(spark, sf):
    path = _tick_files(spark, sf)
    out, chk = (f"{shared_folder(spark)}/{k}-{uuid.uuid4().hex}" for k in ("hist", "chk"))
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).select("symbol", "ts", "price")
    jobs.append_history(s, out, chk).awaitTermination()
    return rounded(spark.read.schema("symbol string, ts timestamp, price double").json(out).select("symbol", "ts", "price"))




def _in_order(spark, df, share: str, parts: int = 4):
    """A stream of ``parts`` micro-batches over ``df``; ``share`` (0 to 1) tells the order of the rows."""
    path = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    df = materialize(df, "stream-source")
    for i in range(parts):  # a later part is a later file
        df.filter(F.least(F.floor(F.expr(share) * parts), F.lit(parts - 1)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _keyed(spark, run):
    """Runs a stateful stream on the RocksDB store, which keeps state on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(name, before)


@query("stream_equity_controller", f"""WITH {STATES} SELECT account, ts, {r('equity', 'equity')}, {r('peak_equity', 'peak_equity')}, {r('dd', 'current_drawdown')}, {r('max_drawdown', 'max_drawdown')}, emergency AS kill_switch,
  risk_state, {r('risk_multiplier', 'risk_multiplier')}, scalp_state, intraday_state, swing_state FROM st""")
def stream_equity(spark, sf):
    s = _in_order(spark, equity(spark, sf).select("account", "ts", "equity", F.lit(False).alias("reset"), (c("pos") / c("n")).alias("share")), "share").drop("share")
    return rounded(_keyed(spark, lambda: _drain(jobs.stream_equity_states(s))).drop("worst_since_recovery"))


@query("stream_pnl_statistics", f"""WITH {TRADES}, d AS (SELECT model, l_shipdate AS ts, sum(pnl) AS x FROM trades GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC) AS i FROM d),
  l AS (SELECT model, x FROM k WHERE i <= 252), q AS (SELECT model, quantile_cont(-x, 0.95) AS v FROM l GROUP BY 1)
  SELECT model, count(*) AS n, {r('avg(CASE WHEN x > 0 THEN 1 ELSE 0 END)', 'win_rate')}, {r('coalesce(avg(x) FILTER (x > 0), 0.01)', 'avg_win')}, {r('coalesce(-avg(x) FILTER (x < 0), 0.01)', 'avg_loss')},
   {r('any_value(v)', 'var')}, {r('avg(-x) FILTER (-x >= v)', 'cvar')} FROM l JOIN q USING (model) GROUP BY 1""")
def stream_pnl(spark, sf):
    d = trades(spark, sf).groupBy("model", c("l_shipdate").alias("ts")).agg(F.sum("pnl").alias("pnl"))
    d = index_rows(d, ["model"], ["ts"], time_bucket("ts", 90 * 86_400), total="n")
    s = _in_order(spark, d.select("model", "ts", "pnl", (c("pos") / c("n")).alias("share")), "share").drop("share")
    out = _keyed(spark, lambda: _drain(jobs.stream_pnl_statistics(s), "update"))
    last = out.groupBy("model").agg(F.max_by(F.struct("n", "win_rate", "avg_win", "avg_loss", "var", "cvar"), "_batch").alias("l"))
    return rounded(last.select("model", "l.*"))


@query("stream_drift_alerts", DRIFT)
def stream_drift(spark, sf):
    """Drift of every model after the last of several batches, from keyed state."""
    e = table(spark, sf, "events").select(c("event_type").alias("model"), "ts", (c("value") / 500).alias("risk_score"))
    e = e.withColumn("share", F.percent_rank().over(Window.partitionBy("model").orderBy("ts")))
    out = _keyed(spark, lambda: _drain(jobs.stream_degradation(_in_order(spark, e, "share").drop("share")), "update"))
    return rounded(out.groupBy("model").agg(F.max_by(F.struct("n", "drift", "alert"), "_batch").alias("l")).select("model", "l.*"))
