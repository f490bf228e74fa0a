"""Text helpers for comparison SQL: rolling frames and staged SELECTs over ``bars``.

They spell the textbook definitions for DuckDB and share nothing with the Spark operators.
"""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY pos"


def over(k: int, ahead: int = 0) -> str:
    return f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND {ahead} FOLLOWING)" if ahead else f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def lag(x, k=1):
    return f"lag({x}, {k}) OVER ({W})"


def lead(x, k=1):
    return f"lead({x}, {k}) OVER ({W})"


def diff(x, k=1):
    return f"({x} - {lag(x, k)})"


def ratio(a, b):
    return f"(({a}) / nullif({b}, 0))"


def pct(x, k=1):
    return f"({ratio(x, lag(x, k))} - 1)"


def grd(a, b):
    return f"(({a}) / nullif(({b}) + 1e-10, 0))"


def flag(c):
    return f"CAST(coalesce({c}, false) AS INTEGER)"


def roll(call, x, k):
    return f"CASE WHEN count({x}) {over(k)} = {k} THEN {call} {over(k)} END"


def mean(x, k):
    return roll(f"avg({x})", x, k)


def rsum(x, k):
    return roll(f"sum({x})", x, k)


def mn(x, k):
    return roll(f"min({x})", x, k)


def mx(x, k):
    return roll(f"max({x})", x, k)


def std(x, k):
    return roll(f"stddev_samp({x})", x, k)


def std0(x, k):
    return roll(f"stddev_pop({x})", x, k)


def var(x, k):
    return roll(f"var_samp({x})", x, k)


def quant(x, q, k):
    return roll(f"quantile_cont({x}, {q})", x, k)


def skew(x, k):
    return roll(f"skewness({x})", x, k)


def kurt(x, k):
    return roll(f"kurtosis({x})", x, k)


def slope(x, k):
    return f"CASE WHEN count({x}) {over(k)} = {k} THEN regr_slope({x}, pos) {over(k)} END"


def corr(a, b, k):
    ok = f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) {over(k)} = {k}"
    c = f"covar_pop({a}, {b}) {over(k)}"
    return f"CASE WHEN {ok} THEN {ratio(c, f'sqrt(var_pop({a}) {over(k)} * var_pop({b}) {over(k)})')} END"


def zscore(x, k):
    return grd(f"{x} - ({mean(x, k)})", std(x, k))


def hits(c, k):
    return f"CASE WHEN pos >= {k - 1} THEN CAST(sum({flag(c)}) {over(k)} AS DOUBLE) END"


def ewm(x, span, adjust=True, memory=512):
    a = 2 / (span + 1)
    rows = f"list({x}) {over(memory)}"
    if adjust:
        return f"(list_reduce({rows}, lambda a, b: b + {1 - a!r} * a) * {a!r} / (1 - pow({1 - a!r}, least(pos + 1, {memory}))))"
    return f"list_reduce({rows}, lambda a, b: {a!r} * b + {1 - a!r} * a)"


def cumsum(x):
    return f"sum({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def cummax(x):
    return f"max({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def true_range():
    return "greatest(high - low, abs(high - prev), abs(low - prev))"


#: The per-bar changes most feature sets start from.
BASE = [
    {"prev": lag("close")},
    {"ret": f"{ratio('close', 'prev')} - 1", "lr": f"ln({ratio('close', 'prev')})", "delta": "close - prev",
     "gain": "CASE WHEN close > prev THEN close - prev ELSE 0 END", "loss": "CASE WHEN close < prev THEN prev - close ELSE 0 END",
     "tr": true_range(), "tp": "(high + low + close) / 3"},
]


def rsi_raw(k, late=False):
    v = f"100 - 100 / (1 + {grd(mean('gain', k), mean('loss', k))})"
    return f"CASE WHEN pos >= {k} THEN {v} END" if late else v


def staged(prelude: str, stages: list[dict], outputs, source: str = "bars", keys: str = "symbol, ts", digits: dict | None = None, where: str = "") -> str:
    """WITH prelude, one CTE per stage, final SELECT of rounded outputs."""
    ctes, last = [], source
    for i, cols in enumerate(stages):
        name = f"s{i}"
        ctes.append(f"{name} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {last})")
        last = name
    digits = digits or {}
    out = ", ".join(f"round(CAST({n} AS DOUBLE), {digits.get(n, 6)}) + 0.0 AS {n}" for n in outputs)
    head = prelude + (", " if ctes else "") + ", ".join(ctes)
    return f"WITH {head} SELECT {keys}, {out} FROM {last} {where}"
