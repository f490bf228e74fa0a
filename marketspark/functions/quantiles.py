"""Exact ranks and quantiles of arbitrarily large groups, without holding a group in one task.

A wanted rank is an open interval of values that is narrowed until few enough values lie inside: a bounded
sketch of the values inside proposes two of them as split points, one aggregate counts what lies below,
and the part with the rank goes on.  All columns and ranks share each aggregate, so rows are neither
multiplied by columns nor shuffled; only the values inside narrow intervals are gathered and sorted.
Every round divides an interval by about a hundred, so their number grows with the logarithm of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Values of one group, column and rank that one task may gather.
BOUND = 1 << 16
#: Distinct values that one bucket of ``distinct_counts`` may hold on average.
BUCKET = 1 << 18
#: Split points that a sketch proposes, and its accuracy; results are exact whatever the sketch answers.
GRID, SKETCH = 256, 10_000


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins a table with one row per key (one row in all without keys); null keys meet null keys."""
    if not keys:  # one row of fixed width
        one = table.withColumn("_one", F.lit(1))
        return df.join(F.broadcast(one), F.lit(1) == F.col("_one"), how).drop("_one")
    renamed = table.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"_on_{k}" for k in keys])


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str, bucket_rows: int = BUCKET, **counts: Column) -> DataFrame:
    """Counts per distinct value with a bucket ``b`` that never decreases along the value.

    ``counts`` are extra sums per value.  Equal values collapse before the shuffle, so a hot value is one
    row.  There are as many buckets as the largest group needs; their limits come from a bounded sketch
    and are found by two short searches.
    """
    rows = df.filter(F.col(value).isNotNull())
    values = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"), *[F.sum(e).alias(n) for n, e in counts.items()])
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-largest // bucket_rows)
    if parts <= 1:
        return values.withColumn("b", F.lit(0))
    return split_bucket(values, rows, keys, value, parts, "b")


def split_bucket(df: DataFrame, sample: DataFrame, keys: Sequence[str], value: str, parts: int, name: str) -> DataFrame:
    """Adds a bucket number that never decreases along ``value``: about equally many rows of ``sample`` lie in each of ``parts`` per key.

    The limits come from a bounded sketch and are found by two short searches.
    """
    marks = [i / parts for i in range(1, parts)]
    # written, so that Spark knows how few rows these are and the rows they are joined to need not meet by group
    sketch = materialize(sample.groupBy(*keys).agg(F.percentile_approx(value, marks, max(SKETCH, 10 * parts)).alias("_splits")), "split-points")
    df = attach(df, sketch, keys)
    width = int(len(marks) ** 0.5) + 1
    below = lambda a: F.size(F.filter(a, lambda s: s < F.col(value)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(len(marks) // width)), lambda k: F.element_at("_splits", (k * width).cast("int"))) if len(marks) >= width else F.slice("_splits", 1, 0)
    df = df.withColumn("_full", below(ends))
    return df.withColumn(name, F.col("_full") * width + below(F.slice("_splits", F.col("_full") * width + 1, F.lit(width)))).drop("_splits", "_full")


def depth_bucket(df: DataFrame, keys: Sequence[str], ts: str, name: str, rows: int = BUCKET) -> DataFrame:
    """Adds an equal-depth time bucket per key, so a key with very many rows in a short time is many buckets; rows of one time share one."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-largest // rows)
    if parts <= 1:
        return df.withColumn(name, F.lit(0))
    df = df.withColumn("_at", F.unix_micros(ts))
    return split_bucket(df, df, keys, "_at", parts, name).drop("_at")


def _split(state: DataFrame, i: int, m: int) -> DataFrame:
    """Two split points around the wanted rank from the sketch of its interval."""
    p = f"{i}_{m}"
    at = F.floor(F.try_divide(F.col(f"_k{p}") - F.col(f"_b{p}") + 0.5, F.col(f"_in{p}")) * GRID).cast("int")
    pick = lambda k: F.get(f"_s{p}", k)
    return state.withColumns({f"_ws{p}": F.when(at >= 2, pick(at - 2)), f"_wt{p}": pick(at + 1)})


def _inside(v: Column, p: str) -> Column:
    # an open end holds infinities (and NaN, the largest) too
    return (F.col(f"_lo{p}").isNull() | (v > F.col(f"_lo{p}"))) & (F.col(f"_hi{p}").isNull() | (v < F.col(f"_hi{p}")))


def _narrow(rows: DataFrame, state: DataFrame, keys: Sequence[str], wanted: list[tuple[int, int]], bound: int) -> DataFrame:
    """One round for the ranks whose interval still holds more than ``bound`` values."""
    marks = [g / GRID for g in range(1, GRID)]
    is_open = lambda p: (F.col(f"_in{p}") > bound) & F.col(f"_x{p}").isNull()
    names = [f"{i}_{m}" for i, m in wanted]
    j = attach(rows, state, keys)
    sketch = j.groupBy(*keys).agg(*[F.percentile_approx(F.when(is_open(p) & _inside(F.col(f"_v{i}"), p), F.col(f"_v{i}")), marks, SKETCH).alias(f"_s{p}")
                                    for (i, _), p in zip(wanted, names)])
    state = attach(state, sketch, keys)
    for i, m in wanted:
        state = _split(state, i, m)
    state = materialize(state.drop(*[f"_s{p}" for p in names]), "rank-splits")
    j = attach(rows, state, keys)
    counts = []
    for (i, _), p in zip(wanted, names):
        v, s1, s2 = F.col(f"_v{i}"), F.col(f"_ws{p}"), F.col(f"_wt{p}")
        counts += [F.count_if(is_open(p) & t).alias(f"_w{n}{p}") for n, t in (("a", v < s1), ("b", v <= s1), ("c", v < s2), ("d", v <= s2))]
    state = attach(state, j.groupBy(*keys).agg(*counts), keys)
    new = {}
    for p in names:
        k, before, end, s1, s2 = F.col(f"_k{p}"), F.col(f"_b{p}"), F.col(f"_b{p}") + F.col(f"_in{p}"), F.col(f"_ws{p}"), F.col(f"_wt{p}")
        a, b = (F.when(s1.isNull(), before).otherwise(F.col(f"_w{n}{p}")) for n in ("a", "b"))
        c, d = (F.when(s2.isNull(), end).otherwise(F.col(f"_w{n}{p}")) for n in ("c", "d"))
        case = F.when(~is_open(p), 0).when(k < a, 1).when(k < b, 2).when(k < c, 3).when(k < d, 4).otherwise(5)
        lo, hi = F.col(f"_lo{p}"), F.col(f"_hi{p}")
        choose = lambda *v, case=case: reduce(lambda w, x: w.when(case == x[0], x[1]), list(enumerate(v))[1:], F.when(case == 0, v[0]))
        new |= {
            f"_lo{p}": choose(lo, lo, lo, F.coalesce(s1, lo), lo, s2), f"_hi{p}": choose(hi, s1, hi, F.coalesce(s2, hi), hi, hi),
            f"_b{p}": choose(before, before, before, b, before, d), f"_in{p}": choose(F.col(f"_in{p}"), a - before, F.lit(1), c - b, F.lit(1), end - d),
            f"_x{p}": choose(F.col(f"_x{p}"), F.lit(None), s1, F.lit(None), s2, F.lit(None))}
    state = state.withColumns(new)
    return materialize(state.drop(*[x for x in state.columns[len(keys):] if x.startswith("_w")]), "rank-intervals")


def wide_values_at(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ranks: Callable[[Column], list[Column]], bound: int = BOUND) -> DataFrame:
    """Interpolated values at 0-based ranks given by ``ranks(n)``, one row per key: ``(keys..., _n0, _q0, _n1, _q1 ...)`` by place of the column.

    Nulls are ignored; a column without a value has a null array.
    """
    keys = list(keys)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    every = range(len(columns))
    per = len(ranks(F.lit(1)))
    largest = rows.groupBy(*keys).agg(F.greatest(*[F.count(f"_v{i}") for i in every], F.lit(0)).alias("n")).agg(F.max("n")).first()[0] or 0
    h = lambda i: [x.cast("double") for x in ranks(F.col(f"_n{i}"))]
    if largest <= bound:
        found = rows.groupBy(*keys).agg(*[F.sort_array(F.collect_list(f"_v{i}")).alias(f"_all{i}") for i in every]).withColumns({f"_n{i}": F.size(f"_all{i}").cast("long") for i in every})
        value = lambda i, j, k: F.get(f"_all{i}", k.cast("int"))
    else:
        wanted = [(i, m) for i in every for m in range(2 * per)]
        state = rows.groupBy(*keys).agg(*[F.count(f"_v{i}").alias(f"_n{i}") for i in every])
        first = {}
        for i, m in wanted:
            p, x = f"{i}_{m}", h(i)[m // 2]
            first |= {f"_k{p}": (F.ceil(x) if m % 2 else F.floor(x)).cast("long"), f"_lo{p}": F.lit(None).cast("double"), f"_hi{p}": F.lit(None).cast("double"),
                      f"_b{p}": F.lit(0).cast("long"), f"_in{p}": F.col(f"_n{i}"), f"_x{p}": F.lit(None).cast("double")}
        state = materialize(state.withColumns(first), "rank-intervals")
        while (state.agg(F.max(F.greatest(F.lit(0), *[F.when(F.col(f"_x{i}_{m}").isNull(), F.col(f"_in{i}_{m}")) for i, m in wanted]))).first()[0] or 0) > bound:
            state = _narrow(rows, state, keys, wanted, bound)
        some = lambda i: reduce(lambda a, b: a | b, [F.col(f"_x{i}_{m}").isNull() & _inside(F.col(f"_v{i}"), f"{i}_{m}") for m in range(2 * per)])
        found = attach(rows, state, keys).groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(some(i), F.col(f"_v{i}")))).alias(f"_all{i}") for i in every])
        found = attach(found, state, keys)

        def value(i, j, k):
            # the same rank as floor and as ceiling: the column is chosen by position, see below
            p = f"{i}_{j}"
            skipped = F.when(F.col(f"_lo{p}").isNull(), 0).otherwise(F.size(F.filter(f"_all{i}", lambda x: x <= F.col(f"_lo{p}"))))
            return F.coalesce(f"_x{p}", F.get(f"_all{i}", (k - F.col(f"_b{p}") + skipped).cast("int")))

    out = []
    for i in every:
        q = []
        for j, x in enumerate(h(i)):
            a, z = value(i, 2 * j, F.floor(x)), value(i, 2 * j + 1, F.ceil(x))
            q.append(F.when(a == z, a + 0.0).otherwise(a + (z - a) * (x - F.floor(x))))  # two equal infinities have no difference
        out += [F.col(f"_n{i}"), F.when(F.col(f"_n{i}") > 0, F.array(*q)).alias(f"_q{i}")]
    # written, so that Spark knows how few rows these are and the rows they are joined to need not meet by group
    return materialize(found.select(*keys, *out), "rank-values")


def values_at(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ranks: Callable[[Column], list[Column]], bound: int = BOUND) -> DataFrame:
    """``wide_values_at`` with one row per key and column that has a value: ``(keys..., column, n, q array)``."""
    found = wide_values_at(df, keys, columns, ranks, bound)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)])
    return found.select(*keys, F.explode(each).alias("_o")).filter("_o.n > 0").select(*keys, "_o.column", "_o.n", "_o.q")


def wide_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], bound: int = BOUND) -> DataFrame:
    """Linear-interpolation quantiles, one row per key: ``(keys..., _n0, _q0 ...)``."""
    return wide_values_at(df, keys, columns, lambda n: [F.lit(float(p)) * (n - 1) for p in probs], bound)


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], bound: int = BOUND) -> DataFrame:
    """Linear-interpolation quantiles: ``(keys..., column, n, q array)``."""
    return values_at(df, keys, columns, lambda n: [F.lit(float(p)) * (n - 1) for p in probs], bound)
