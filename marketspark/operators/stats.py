"""Risk and return statistics: VaR / CVaR, payoff, equity, trades, AUC, KS, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import attach, distinct_counts, exact_quantiles, values_at
from ..functions.series import Pieces, flag, guarded, index_rows, ratio, running, with_carries
from ..session import materialize

#: Fixed values.
WINDOW, MIN_SAMPLES, BLOCK, STRESS, CONFIDENCE = 252, 30, 0.08, 1.5, 0.95
MODEL_LIMITS = {"scalp": 0.05, "intraday": 0.07, "swing": 0.10, "portfolio": 0.08}
LEVELS = ((0.01, "minimal"), (0.02, "low"), (0.05, "moderate"), (0.10, "high"), (0.15, "extreme"))


def chain(c: Column, steps, last: str) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(c <= bound, name) if out is None else out.when(c <= bound, name)
    return out.otherwise(last)


def risk_level(cvar: Column) -> Column:
    return chain(cvar, LEVELS, "blocked")


def lookup(key: Column, mapping: dict[str, float], default: float) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str = "_rank") -> DataFrame:
    """Last n rows per key; Spark keeps only n per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


# ---------------------------------------------------------------- arrays of bounded size


def array_quantile(sorted_array: Column, q: float) -> Column:
    h = F.lit(q) * (F.size(sorted_array) - 1)
    lo = F.get(sorted_array, F.floor(h).cast("int"))
    return lo + (F.get(sorted_array, F.ceil(h).cast("int")) - lo) * (h - F.floor(h))


def array_mean(a: Column) -> Column:
    return ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def recent_tail_risk(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], window: int = WINDOW,
                     min_samples: int = MIN_SAMPLES, block: float = BLOCK, confidence: float = CONFIDENCE) -> DataFrame:
    """Historical VaR and CVaR of losses over the last ``window`` rows per key, with stress and level.

    Fewer than ``min_samples`` rows give the blocking value.  The window bounds the array per key.
    """
    tail = last_rows(df.filter(F.col(value).isNotNull()), keys, order, window)
    a = tail.groupBy(*keys).agg(F.array_sort(F.collect_list(-F.col(value))).alias("_l"))
    a = a.withColumns({"n_samples": F.size("_l"), "_var": array_quantile(F.col("_l"), confidence),
                       "_p99": array_quantile(F.col("_l"), 0.99)})
    a = a.withColumn("_tail", F.filter("_l", lambda x: x >= F.col("_var")))
    a = a.withColumn("_cvar", F.coalesce(array_mean(F.col("_tail")), F.col("_var")))
    return finish_tail_risk(a.withColumns({"_nt": F.size("_tail"), "_max": F.array_max("_l")}), keys, min_samples, block)


def finish_tail_risk(a: DataFrame, keys: Sequence[str], min_samples: int = MIN_SAMPLES, block: float = BLOCK) -> DataFrame:
    enough = F.col("n_samples") >= min_samples
    cvar = F.when(enough, F.col("_cvar")).otherwise(block)
    stress = F.col("_cvar") * STRESS
    stress = F.when(F.col("_p99") > F.col("_cvar") * 2, F.greatest(stress, F.col("_p99") * 1.2)).otherwise(stress)
    a = a.withColumns({
        "var": F.when(enough, F.col("_var")).otherwise(0.0), "cvar": cvar,
        "stress_cvar": F.when(enough, stress).otherwise(block * STRESS),
        "max_loss": F.when(enough, F.col("_max")).otherwise(0.0),
        "tail_observations": F.when(enough, F.col("_nt")).otherwise(0),
    })
    a = a.withColumns({
        "risk_level": F.when(enough, risk_level(F.col("cvar"))).otherwise("blocked"),
        "is_blocked": ~enough | (F.col("cvar") > block) | (F.col("stress_cvar") > block * 1.5),
    })
    return a.select(*keys, "n_samples", "var", "cvar", "stress_cvar", "max_loss", "tail_observations", "risk_level", "is_blocked")


def loss_features(tail: DataFrame, prefix: str = "model") -> DataFrame:
    """Tail statistics as model inputs, the level as its ordinal."""
    code = {name: float(i) for i, (_, name) in enumerate(LEVELS)} | {"blocked": float(len(LEVELS))}
    return tail.withColumns({
        f"{prefix}_cvar_95": F.col("cvar"), f"{prefix}_var_95": F.col("var"), f"{prefix}_max_loss": F.col("max_loss"),
        f"{prefix}_cvar_stress": F.col("stress_cvar"), f"{prefix}_risk_level": lookup(F.col("risk_level"), code, 0.0),
        f"{prefix}_tail_ratio": F.col("tail_observations") / F.greatest(F.col("n_samples"), F.lit(1)),
    })


# ---------------------------------------------------------------- unbounded groups


def with_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Attach an exact group quantile to every row."""
    t = exact_quantiles(df, keys, [value], [q]).select(*keys, F.col("q")[0].alias(name))
    return attach(df, t, keys)


def return_tail(df: DataFrame, keys: Sequence[str], value: str, confidence: float = CONFIDENCE) -> DataFrame:
    """Return-side VaR and CVaR (negative numbers) of whole groups."""
    rows = with_quantile(df, keys, value, 1 - confidence, "var")
    return rows.groupBy(*keys).agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(value) <= F.col("var"), F.col(value))).alias("cvar"),
        F.count(value).alias("n"), F.count_if(F.col(value) <= F.col("var")).alias("n_tail"), F.min(value).alias("worst"))


def worst_tail_mean(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.01) -> DataFrame:
    """Mean of the max(1, int(n*share)) smallest values, from the value at that rank.

    Ties at the rank are counted, so no row list is needed.
    """
    k = lambda n: F.greatest(F.lit(1), F.floor(n * share))
    at = values_at(df, keys, [value], lambda n: [k(n) - 1]).select(*keys, "n", F.col("q")[0].alias("_v"))
    agg = attach(df, at, keys).groupBy(*keys).agg(
        F.max(k(F.col("n"))).alias("n_tail"), F.max("_v").alias("_v"),
        F.coalesce(F.sum(F.when(F.col(value) < F.col("_v"), F.col(value))), F.lit(0.0)).alias("_s"),
        F.count_if(F.col(value) < F.col("_v")).alias("_c"))
    return agg.select(*keys, "n_tail", ((F.col("_s") + F.col("_v") * (F.col("n_tail") - F.col("_c"))) / F.col("n_tail")).alias("worst_tail_mean"))


def stressed(value: Column, multiplier: float = 2.0) -> Column:
    """Negative returns scaled up."""
    return F.when(value < 0, value * multiplier).otherwise(value)


def cvar_penalty(cvar: Column, weight: float = 0.1) -> Column:
    return cvar * weight


def cvar_excess_penalty(cvar: Column, threshold: float = 0.03) -> Column:
    a = F.abs(cvar)
    return F.when(a > threshold, F.pow(a - threshold, F.lit(2.0)) * 100).otherwise(0.0)


def aligned_portfolio(df: DataFrame, model: str, value: str, order: Sequence[str], models: Sequence[str],
                      weights: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """Model returns aligned from the end: one row per position with a weighted sum.

    The statistics downstream use the last ``window`` positions, so only those are kept.
    """
    total = sum((weights or dict.fromkeys(models, 1.0)).values())
    w = {m: (weights or dict.fromkeys(models, 1.0))[m] / total for m in models}
    tail = last_rows(df.filter(F.col(model).isin(list(models))), [model], order, window)
    wide = tail.groupBy("_rank").agg(*[F.max(F.when(F.col(model) == m, F.col(value))).alias(f"r_{m}") for m in models])
    wide = wide.dropna(subset=[f"r_{m}" for m in models])
    mix = sum((F.col(f"r_{m}") * w[m] for m in models), F.lit(0.0))
    return wide.withColumn("portfolio", mix)


def portfolio_tail_risk(df: DataFrame, model: str, value: str, order: Sequence[str], models: Sequence[str],
                        weights: dict[str, float] | None = None, corr_rows: DataFrame | None = None) -> DataFrame:
    """CVaR of the weighted mix, raised when the models move together (mean correlation > 0.7)."""
    wide = aligned_portfolio(df, model, value, order, models, weights)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    from ..functions.series import correlation

    corr = wide.agg(*[correlation(F.col(f"r_{a}"), F.col(f"r_{b}")).alias(f"c_{a}_{b}") for a, b in pairs])
    rho = sum((F.col(f"c_{a}_{b}") for a, b in pairs), F.lit(0.0)) / len(pairs)
    corr = corr.select(F.lit("portfolio").alias("model"), rho.alias("avg_correlation"))
    tail = recent_tail_risk(wide.select(F.lit("portfolio").alias("model"), "portfolio", (-F.col("_rank")).alias("k")), ["model"], "portfolio", ["k"])
    out = tail.join(corr, "model")
    high = F.col("avg_correlation") > 0.7
    factor = F.when(high, 0.5 + F.col("avg_correlation")).otherwise(1.0)
    out = out.withColumns({"cvar": F.col("cvar") * factor, "stress_cvar": F.col("stress_cvar") * factor})
    return out.withColumns({"risk_level": risk_level(F.col("cvar")),
                            "is_blocked": F.when(high, F.col("cvar") > MODEL_LIMITS["portfolio"]).otherwise(F.col("is_blocked"))})


def payoff(df: DataFrame, keys: Sequence[str], pnl: str) -> DataFrame:
    """Win rate and payoff ratio; a missing side counts .01, and the mean loss is at least .01."""
    x = F.col(pnl)
    g = df.groupBy(*keys).agg(F.count(x).alias("n_trades"), F.avg(flag(x > 0)).alias("win_rate"),
                              F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.01)).alias("avg_win"),
                              F.coalesce(F.abs(F.avg(F.when(x < 0, x))), F.lit(0.01)).alias("avg_loss"))
    return g.withColumn("payoff_ratio", F.col("avg_win") / F.greatest("avg_loss", F.lit(0.01)))


# ---------------------------------------------------------------- equity and trades


def equity_metrics(equity: DataFrame, initial: float, keys: Sequence[str] = ("account",), pos: str = "pos",
                   start: str = "ts", rows: int | None = None) -> DataFrame:
    """Return, drawdown and ratio metrics of equity curves ``(keys, pos, ts, equity)``."""
    s = Pieces(equity, keys=keys, pos=pos, halo=16, rows=rows)
    s.expanding(_peak=("max", F.col("equity")))
    s.stage(_r=s.pct("equity"), _dd=F.col("equity") - F.col("_peak"))
    s.stage(r=F.col("_r"), dd=F.col("_dd"), peak=F.col("_peak"))
    neg = F.when(F.col("r") < 0, F.col("r"))
    days = F.greatest(F.lit(1), F.floor((F.unix_seconds(F.max(start)) - F.unix_seconds(F.min(start))) / 86_400))
    m = s.close().groupBy(*keys).agg(
        F.max_by("equity", pos).alias("final_equity"), days.alias("days"),
        F.abs(F.min("dd")).alias("max_drawdown"),
        F.min_by("peak", F.struct("dd", pos)).alias("_peak_at"),
        F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.stddev_samp(neg).alias("_d"))
    tr = (F.col("final_equity") - initial) / initial
    root = F.sqrt(F.lit(252.0))
    m = m.withColumns({
        "total_return": F.col("final_equity") - initial, "total_return_pct": tr,
        "annualized_return": F.pow(1 + tr, F.lit(365.0) / F.col("days")) - 1,
        "max_drawdown_pct": ratio("max_drawdown", "_peak_at"),
        "sharpe_ratio": F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * root).otherwise(0.0),
        "sortino_ratio": F.when(F.col("_d") > 0, F.col("_m") / F.col("_d") * root).otherwise(0.0),
    })
    return m.withColumn("calmar_ratio", F.when(F.col("max_drawdown_pct") > 0, F.col("annualized_return") / F.col("max_drawdown_pct"))
                        .otherwise(0.0)).drop("_peak_at", "_m", "_s", "_d")


def trade_metrics(trades: DataFrame, keys: Sequence[str] = ("account",), pnl: str = "pnl",
                  entry: str | None = None, exit: str | None = None) -> DataFrame:
    x = F.col(pnl)
    win, lose = F.when(x > 0, x), F.when(x <= 0, x)
    aggs = [F.count(x).alias("total_trades"), F.count(win).alias("winning_trades"), F.count(lose).alias("losing_trades"),
            F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"), F.abs(F.sum(lose)).alias("_loss"),
            F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(lose), F.lit(0.0)).alias("avg_loss"),
            F.avg(x).alias("avg_trade")]
    if entry and exit:
        hours = (F.unix_micros(F.col(exit)) - F.unix_micros(F.col(entry))) / 3.6e9
        aggs.append(F.coalesce(F.avg(hours), F.lit(0.0)).alias("avg_duration_h"))
    m = trades.groupBy(*keys).agg(*aggs)
    loss = F.coalesce("_loss", F.lit(1.0))
    m = m.withColumns({"win_rate": F.col("winning_trades") / F.col("total_trades"),
                       "profit_factor": F.when(loss > 0, F.col("gross_profit") / F.when(loss > 0, loss)).otherwise(0.0)})
    return m.withColumn("expectancy", F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss")).drop("_loss")


def streaks(trades: DataFrame, keys: Sequence[str] = ("account",), pnl: str = "pnl", pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Longest run of wins (>0) and of losses (<=0) in row order."""
    s = Pieces(trades, keys=keys, pos=pos, halo=16, rows=rows)
    s.stage(win=(F.col(pnl) > 0).cast("int"))
    s.stage(_pw=s.lag("win"))
    s.expanding(since=("max", F.when(F.col("_pw").isNull() | (F.col("win") != F.col("_pw")), F.col(pos))))
    run = F.col(pos) - F.col("since") + 1
    g = s.close().groupBy(*keys).agg(F.max(F.when(F.col("win") == 1, run)).alias("_w"), F.max(F.when(F.col("win") == 0, run)).alias("_l"))
    return g.select(*keys, F.coalesce("_w", F.lit(0)).alias("max_win_streak"), F.coalesce("_l", F.lit(0)).alias("max_loss_streak"))


def return_bundle(returns: DataFrame, keys: Sequence[str], value: str = "r", pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Metric bundle of a return series: tail, compounding drawdown, ratios (population std), stability."""
    r = F.col(value)
    s = Pieces(returns, keys=keys, pos=pos, halo=16, rows=rows)
    s.running_from(returns, _lg=("sum", F.log1p(r)))
    s.stage(eq=F.when(F.log1p(r).isNotNull(), F.exp("_lg")))
    # the equity one row before is this one without this return
    s.stage(pk=s.inside("max", F.col("eq")), step=F.when(s.lag(value).isNotNull(), ratio(F.col("eq") * r, 1 + r)))
    t = materialize(s.close().select(*keys, pos, value, "eq", "pk", "step"), "equity")
    t = with_carries(t, keys, {"_pk": ("max", F.col("pk"))}, s.rows, pos).withColumn("pk", F.greatest("_pk", "pk"))
    rows_ = with_quantile(t.withColumn("dd", guarded(F.col("pk") - F.col("eq"), "pk")), keys, value, 0.05, "p05")
    neg = F.when(r < 0, r)
    m = rows_.groupBy(*keys).agg(
        F.count(r).alias("n"), F.abs(F.avg(F.when(r <= F.col("p05"), r))).alias("cvar"), F.max("dd").alias("max_drawdown"),
        F.avg(flag(r < F.col("p05"))).alias("tail_loss_frequency"), F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"),
        F.stddev_pop(neg).alias("_d"), F.stddev_pop("step").alias("_st"), F.avg("eq").alias("_em"),
        F.count_if(r > 0).alias("_w"), F.sum(F.when(r > 0, r)).alias("_sw"), F.sum(F.abs(neg)).alias("_sl"))
    root = F.sqrt(F.lit(252.0))
    safe = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return m.select(
        *keys, "n", "cvar", "max_drawdown", "tail_loss_frequency",
        (safe(F.col("_m"), F.col("_s")) * root).alias("sharpe_ratio"), (safe(F.col("_m"), F.col("_d")) * root).alias("sortino_ratio"),
        safe(F.col("_m") * 252, F.col("max_drawdown")).alias("calmar_ratio"),
        F.when(F.col("n") > 10, 1 - guarded("_st", "_em")).otherwise(0.0).alias("equity_stability"),
        (F.col("_w") / (F.col("n") + 1e-10)).alias("win_rate"),
        safe(F.coalesce("_sw", F.lit(0.0)), F.coalesce("_sl", F.lit(0.0))).alias("profit_factor"))


#: Weights of the multi-objective score.
OBJECTIVE = {"auc": 0.15, "cvar": -0.20, "max_drawdown": -0.20, "tail_loss_frequency": -0.10, "sharpe_ratio": 0.15,
             "sortino_ratio": 0.10, "equity_stability": 0.10}


def objective(df: DataFrame) -> DataFrame:
    """Weighted multi-objective score and the trial score auc - 10 cvar - 5 maxdd."""
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in OBJECTIVE.items() if c in df.columns), F.lit(0.0))
    return df.withColumns({"weighted_score": score, "trial_score": F.col("auc") - 10 * F.col("cvar") - 5 * F.col("max_drawdown")})


def decision_statistics(decisions: DataFrame, keys: Sequence[str], value: str = "r", pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Shares per outcome and statistics of the returns that followed."""
    r = F.col(value)
    s = Pieces(decisions, keys=keys, pos=pos, halo=16, rows=rows)
    s.running_from(decisions, _cum=("sum", r))
    s.stage(cum=F.when(r.isNotNull(), F.col("_cum")))
    s.stage(top=s.inside("max", F.col("cum")))
    df = with_carries(materialize(s.close(), "decisions"), keys, {"_top": ("max", F.col("top"))}, s.rows, pos).withColumn("top", F.greatest("_top", "top")).drop("_top")
    head = with_quantile(df.withColumn("_loss", -r), keys, "_loss", 0.95, "var95")
    # written, as the quantiles are, so that rows need not meet by group
    base = materialize(df.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"), F.min("cum").alias("_lo")), "decision-totals")
    j = attach(head, base, keys)
    m = j.groupBy(*keys).agg(
        F.avg(flag(F.col("decision") == "approved")).alias("approval_rate"), F.avg(flag(F.col("decision") == "rejected")).alias("rejection_rate"),
        F.avg(flag(F.col("decision") == "size_reduced")).alias("size_reduction_rate"), F.first("_m").alias("mean_return"), F.first("_s").alias("_s"),
        F.abs(F.min((F.col("cum") - F.col("top")) / (F.col("top") + 1e-10 + F.abs("_lo")))).alias("max_drawdown"),
        F.avg(F.when(F.col("_loss") >= F.col("var95"), F.col("_loss"))).alias("cvar_95"),
        F.avg(flag(r < -2 * F.col("_s"))).alias("tail_loss_frequency"))
    return m.withColumns({"sharpe_ratio": guarded("mean_return", "_s") * F.sqrt(F.lit(252.0)),
                          "equity_stability": 1 / (1 + F.col("_s") * 100)}).drop("_s")


# ---------------------------------------------------------------- model metrics


def classification_metrics(df: DataFrame, label: str, probs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and log-loss of class probabilities (class = position in ``probs``)."""
    arr = F.array(*[F.col(p) for p in probs])
    pred = F.array_position(arr, F.array_max(arr)) - 1
    p_true = F.least(F.greatest(F.get(arr, F.col(label).cast("int")), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(flag(pred == F.col(label))).alias("accuracy"), F.avg(-F.log(p_true)).alias("log_loss"))


def auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by average ranks, ties counted half."""
    v = distinct_counts(df, keys, score, pos=flag(positive))
    v = v.withColumn("neg", F.col("c") - F.col("pos"))
    v = running(v, keys, [score], F.col("b"), {"below": ("sum", F.col("neg").cast("double"))}, inclusive=False)
    g = v.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.select(*keys, F.col("np").alias("n_pos"), F.col("nn").alias("n_neg"), ratio("u", F.col("np") * F.col("nn")).alias("auc"))


def multiclass_auc(df: DataFrame, label: str, probs: Sequence[str]) -> DataFrame:
    """One-versus-rest AUC per class with macro and weighted means."""
    item = F.explode(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(p).alias("s"), (F.col(label) == i).alias("y")) for i, p in enumerate(probs)]))
    per = auc(df.select(item.alias("x")).select("x.cls", "x.s", "x.y"), ["cls"], "s", F.col("y"))
    return per.agg(F.avg("auc").alias("auc_macro"), ratio(F.sum(F.col("auc") * F.col("n_pos")), F.sum("n_pos")).alias("auc_weighted"))


def regression_metrics(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(label) - F.col(pred)
    g = df.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                              F.sum(e * e).alias("_sse"), (F.var_pop(label) * F.count(label)).alias("_sst"))
    return g.withColumn("r2", 1 - ratio("_sse", "_sst")).drop("_sse", "_sst")


def confident_accuracy(df: DataFrame, label: str, probs: Sequence[str], threshold: float = 0.55) -> DataFrame:
    arr = F.array(*[F.col(p) for p in probs])
    top = F.array_max(arr)
    hit = flag(F.array_position(arr, top) - 1 == F.col(label))
    return df.filter(top >= threshold).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def ks_two_sample(df: DataFrame, keys: Sequence[str], value: str, side: Column, terms: int = 100) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p-value.

    ``side`` is true for the first sample.  Distribution functions come from counts per distinct
    value and a bucketed running sum.
    """
    v = distinct_counts(df, keys, value, a=flag(side))
    v = v.withColumn("z", F.col("c") - F.col("a"))
    tot = v.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("z").alias("nz"))
    v = running(v, keys, [value], F.col("b"), {"ca": ("sum", F.col("a").cast("double")), "cz": ("sum", F.col("z").cast("double"))})
    if keys:
        v = v.join(tot, list(keys))
    else:
        v = v.join(F.broadcast(tot.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")
    g = v.groupBy(*keys).agg(F.first("na").alias("n1"), F.first("nz").alias("n2"),
                             F.max(F.abs(ratio("ca", "na") - ratio("cz", "nz"))).alias("statistic"))
    lam = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))) * F.col("statistic")
    g = g.withColumn("_l", lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1)
                         * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l")))
    p = F.when(F.col("_l") < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
    return g.withColumn("p_value", p).drop("_l")


def period_stability(df: DataFrame, score: str, period: str, flag_above: float = 0.20) -> DataFrame:
    """Score per time period against the trend: halves, coefficient of variation, slope.

    One row per period goes in, so the summary is small.
    """
    p = df.groupBy(period).agg(F.avg(score).alias("v"))
    half = p.agg(F.max(period).alias("_hi")).withColumn("_one", F.lit(1))
    p = p.join(F.broadcast(half), F.lit(1) == F.col("_one"))
    first = F.avg(F.when(F.col(period) * 2 < F.col("_hi") + 1, F.col("v")))
    second = F.avg(F.when(F.col(period) * 2 >= F.col("_hi") + 1, F.col("v")))
    g = p.agg(F.count("v").alias("periods"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), first.alias("_a"), second.alias("_b"),
              F.regr_slope("v", F.col(period).cast("double")).alias("trend"))
    g = g.withColumns({"degradation": ratio(F.col("_a") - F.col("_b"), "_a"), "cv": ratio("std", F.abs("mean"))})
    return g.withColumns({"degraded": F.col("degradation") > flag_above, "unstable": F.col("cv") > 0.2}).drop("_a", "_b")


def trial_stability(trials: DataFrame, study: str, order: str, score: str, limit: float = 0.1, bucket: Column | None = None) -> DataFrame:
    """Coefficient of variation over the later half of the trials of each study."""
    t = index_rows(trials, [study], [order], bucket if bucket is not None else F.floor(F.col(order) / 4096), total="_n")
    g = t.filter(F.col("pos") >= F.floor(F.col("_n") / 2)).groupBy(study).agg(F.count(score).alias("n_late"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return g.withColumn("cv", guarded("std", F.abs("mean"))).withColumn("stable", F.col("cv") < limit)


def risk_objectives(df: DataFrame, label: str, pred: str) -> DataFrame:
    """RMSE, mean absolute error beyond its 95th percentile, share of under-prediction among the
    top fifth of true risk."""
    e = df.withColumn("_e", F.abs(F.col(label) - F.col(pred)))
    q = exact_quantiles(e, (), ["_e"], [0.95]).select(F.col("q")[0].alias("_p95"), F.lit(1).alias("_one"))
    t = exact_quantiles(e, (), [label], [0.8]).select(F.col("q")[0].alias("_p80"), F.lit(1).alias("_two"))
    j = e.join(F.broadcast(q), F.lit(1) == F.col("_one")).join(F.broadcast(t), F.lit(1) == F.col("_two"))
    top = F.col(label) > F.col("_p80")
    return j.agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.when(F.col("_e") >= F.col("_p95"), F.col("_e"))).alias("tail_error"),
                 F.avg(F.when(top, flag(F.col(pred) < F.col(label)))).alias("under_prediction_rate"))


#: Percentile bounds of the volatility regimes.
VOL_REGIMES = ((0.25, "low"), (0.50, "medium"), (0.75, "high"))


def volatility_regime(s: Pieces, vol: str, lookback: int = 20, history: int = 999) -> Column:
    """Regime of the current volatility among up to ``history`` earlier values of the series.

    Mean-rank percentile; fewer than ``lookback`` values so far give ``medium``.
    """
    seen = F.count(vol).over(s.frame(-history, 0))
    pct = s.ask("share_below", vol, history)
    regime = F.when(pct < 0.25, "low").when(pct < 0.5, "medium").when(pct < 0.75, "high").otherwise("extreme")
    return F.when(F.col(vol).isNull(), None).when((seen < lookback) | pct.isNull(), "medium").otherwise(regime)


def limit_table(returns: DataFrame, value: str, scales: dict[str, float] | None = None, weights: dict[str, float] | None = None,
                confidences: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """VaR and CVaR (positive losses) per confidence, per scaled model and for the weighted mix, against limits.

    Scaling by a positive factor scales VaR and CVaR with it, so one pass per confidence serves all rows.
    """
    scales = scales or {"scalp": 1.2, "intraday": 1.0, "swing": 0.8}
    weights = weights or {"scalp": 0.3, "intraday": 0.5, "swing": 0.2}
    limits = {"intraday": 0.07, "scalp": 0.05, "swing": 0.10, "portfolio": 0.08}
    factors = {**scales, "portfolio": sum(scales[m] * w for m, w in weights.items())}
    out = None
    for c in confidences:
        t = return_tail(returns, (), value, c)
        rows = [F.struct(F.lit(m).alias("model"), F.lit(f).alias("f"), F.lit(limits[m]).alias("limit")) for m, f in factors.items()]
        t = t.select(F.lit(c).alias("confidence"), "var", "cvar", F.explode(F.array(*rows)).alias("m"))
        t = t.select("confidence", "m.model", (-F.col("var") * F.col("m.f")).alias("var"), (-F.col("cvar") * F.col("m.f")).alias("cvar"), "m.limit")
        out = t if out is None else out.unionByName(t)
    return out.withColumn("within_limit", F.col("cvar") < F.col("limit"))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """Largest and mean absolute difference per column and whether all values are close."""
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(
        b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), list(keys), "full_outer")
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("x"), F.col(f"b_{c}").cast("double").alias("y")) for c in columns]))
    long = j.select(item.alias("i")).select("i.*")
    d = F.abs(F.col("x") - F.col("y"))
    close = F.coalesce(d <= atol + rtol * F.abs("y"), F.col("x").isNull() & F.col("y").isNull())
    return long.groupBy("column").agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.count_if(~close).alias("n_far"), F.every(close).alias("all_close"))


def monitoring(log: DataFrame, keys: Sequence[str] = ("model",), max_latency_ms: float = 100.0) -> DataFrame:
    """Counts, blocked share, latency and health of a decision log."""
    g = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.avg(flag(F.col("blocked"))).alias("blocked_share"), F.avg("latency_ms").alias("avg_latency_ms"),
                               F.max("latency_ms").alias("max_latency_ms"), F.avg("risk_score").alias("avg_risk"), F.count_if(F.col("degraded")).alias("degradation_alerts"))
    g = g.withColumn("issues", F.concat_ws("; ", F.array_compact(F.array(
        F.when(F.col("avg_latency_ms") > max_latency_ms, "high latency"),
        F.when((F.col("total") > 100) & (F.col("blocked_share") > 0.5), "high block rate"),
        F.when(F.col("degradation_alerts") > 5, "signal degradation")))))
    return g.withColumn("is_healthy", F.col("avg_latency_ms") <= max_latency_ms)


#: Allowed (critical failures, failures, warnings) per verdict.
GO, CONDITIONAL = (0, 1, 10), (0, 3, 20)


def verdict(checks: DataFrame) -> DataFrame:
    """Roll checks ``(checkpoint, critical, passed, n_warnings, n_errors)`` up to one verdict row."""
    g = checks.agg(F.count(F.lit(1)).alias("checkpoints"), F.count_if("passed").alias("passed"), F.sum("n_warnings").alias("warnings"), F.sum("n_errors").alias("errors"),
                   F.count_if(F.col("critical") & ~F.col("passed")).alias("critical_failures"))
    fails, crit, warn = F.col("checkpoints") - F.col("passed"), F.col("critical_failures"), F.col("warnings")
    return g.withColumn("verdict", F.when((crit <= GO[0]) & (fails <= GO[1]) & (warn <= GO[2]), "GO")
                        .when((crit <= CONDITIONAL[0]) & (fails <= CONDITIONAL[1]), "CONDITIONAL GO").otherwise("NO-GO"))
