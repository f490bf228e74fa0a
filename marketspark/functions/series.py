"""Ordered-series primitives that never put one whole series into one task.

A long series (one symbol may hold a third of all rows) is cut into *pieces* of a fixed
number of rows.  Every piece carries a *halo*: copies of the rows just before it (and,
for labels, just after it), so that rolling frames, lags and decaying averages give
the same values as on the whole series.  Expanding values (running sum, running maximum,
last known value) use a two-level scan: per-piece summaries, a prefix over the few
summaries, and a running value inside the piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship
from .windows import piece_windows

EPS = 1e-10
PIECE_ROWS = 32_768
HALO_ROWS = 1_024


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a/b with null instead of an infinite value."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def guarded(a: Column | str, b: Column | str) -> Column:
    """a/(b+eps), the usual guard against empty denominators."""
    return ratio(a, col(b) + F.lit(EPS))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bounded value; null stays null (least/greatest alone would skip it)."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi)))


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """Monotone bucket number of a timestamp."""
    return F.floor(F.unix_seconds(col(ts)) / F.lit(seconds)).cast("long")


def correlation(a: Column, b: Column, over=None) -> Column:
    """Pearson correlation, null for a constant input (the built-in raises in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    parts = (F.covar_pop(a, b), F.var_pop(F.when(both, a)), F.var_pop(F.when(both, b)))
    cov, va, vb = (p.over(over) if over is not None else p for p in parts)
    return ratio(cov, F.sqrt(va * vb))


# --------------------------------------------------------------------------- two-level scan

RUNNING = {
    "sum": (F.sum, lambda carry, here: F.coalesce(carry, F.lit(0.0)) + here),
    "count": (F.count, lambda carry, here: F.coalesce(carry, F.lit(0)) + here),
    "max": (F.max, lambda carry, here: F.greatest(carry, here)),
    "min": (F.min, lambda carry, here: F.least(carry, here)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    specs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Expanding sum/count/max/min/last per key without one task per key.

    ``bucket`` must be non-decreasing along ``order``.  ``specs`` maps an output name to
    ``(kind, expression)``; kind ``last`` is the latest non-null value.  The only
    window that spans a key runs over one row per bucket.
    """
    df = df.withColumn("_bucket", bucket)
    seq = F.struct(*[F.col(c) for c in order])
    summary, prefix, local, final = [], [], {}, {}
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    for name, (kind, expr) in specs.items():
        stamped = kind == "last"
        fn, merge = RUNNING["max" if stamped else kind]
        value = F.when(expr.isNotNull(), F.struct(seq.alias("s"), expr.alias("v"))) if stamped else expr
        summary.append(fn(value).alias(f"_s_{name}"))
        prefix.append(fn(f"_s_{name}").over(before).alias(f"_c_{name}"))
        here = fn(value).over(inside)
        if kind == "sum":
            here = F.coalesce(here, F.lit(0.0))
        local[name] = merge(F.col(f"_c_{name}"), here)
        final[name] = F.col(name)["v"] if stamped else F.col(name)
    carry = df.groupBy(*keys, "_bucket").agg(*summary).select(*keys, "_bucket", *prefix)
    out = df.join(carry, [*keys, "_bucket"], "left").withColumns(local)
    out = out.withColumns({n: e for n, e in final.items() if specs[n][0] == "last"})
    return out.drop("_bucket", *[f"_c_{n}" for n in specs])


def index_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, pos: str = "pos", total: str | None = None
) -> DataFrame:
    """0-based position of every row in its series; ``order`` must be unique per key."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    cols = [F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(total))
    counts = counts.select(*keys, "_bucket", *cols)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        df.join(counts, [*keys, "_bucket"])
        .withColumn(pos, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_before")
    )


def carries(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, Column]], piece: str = "_piece") -> DataFrame:
    """State before each piece of a series: one partial aggregate, then a window over one row per piece.

    Kinds: ``sum``, ``max``, ``min`` and ``since``, whose expression is a struct (r, d): r is the place of the
    last reset inside the piece up to a row (-1: none), d a value at that row.  The state is the largest d since
    the last reset: states of two neighbouring pieces merge into that of both.
    """
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "since": F.max}
    g = df.groupBy(*keys, piece).agg(*[fn[kind](expr).alias(n) for n, (kind, expr) in specs.items()])
    along = Window.partitionBy(*keys).orderBy(piece)
    upto, before = (along.rowsBetween(Window.unboundedPreceding, last) for last in (0, -1))
    g = g.withColumns({n: F.struct(F.max(F.col(n)["r"]).over(upto).alias("r"), F.col(n)["d"].alias("d")) for n, (kind, _) in specs.items() if kind == "since"})
    return g.select(*keys, piece, *[fn[kind](n).over(before).alias(n) for n, (kind, _) in specs.items()])


def with_carries(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, Column]], rows: int, pos: str = "pos") -> DataFrame:
    """``df`` with the state before each row's piece; ``df`` should be a written table, since it is read twice."""
    df = df.withColumn("_piece", F.floor(F.col(pos) / rows).cast("long"))
    return df.join(carries(df, keys, specs), [*keys, "_piece"], "left").drop("_piece")


# --------------------------------------------------------------------------- pieces with halo


class Pieces:
    """A series table cut into pieces, with the window vocabulary to compute over it.

    ``stage`` adds columns; a column that looks at other rows can only use columns of
    earlier stages.  Names starting with an underscore are dropped by ``close``.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str] = ("symbol",), pos: str = "pos", halo: int = HALO_ROWS,
                 ahead: int = 0, rows: int | None = None, block: int = 512):
        self.rows = rows or PIECE_ROWS
        if halo > self.rows or ahead > self.rows:
            raise ValueError("a halo must not be longer than a piece")
        self.keys, self.pos, self.halo, self.block = list(keys), pos, halo, block
        p = F.col(pos)
        first = F.greatest(F.floor((p - ahead) / self.rows), F.lit(0))
        last = F.floor((p + halo) / self.rows)
        df = df.withColumn("_piece", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        # a fixed number of partitions: windows are heavy on CPU for their bytes, so merging pieces by
        # byte size (as adaptive execution would) leaves most cores idle
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(parts, *self.keys, "_piece")
        self.df = df.withColumns({
            "_core": F.floor(p / self.rows) == F.col("_piece"),
            "_blk": F.floor(p / block).cast("long"),
        })
        self.part = [*self.keys, "_piece"]
        self.asked: dict[tuple, str] = {}
        self.open: list[tuple] = []
        self.dry, self.count = False, 0
        self.w0 = Window.partitionBy(*self.part).orderBy(pos)

    # -- plumbing
    def stage(self, **cols: Column) -> "Pieces":
        if self.dry:
            return self
        self.fetch()
        self.df = self.df.withColumns(cols)
        return self

    # -- windows that one pass over the rows of a piece computes (order statistics, lengths from a column)
    def ask(self, kind: str, c, k, share: float | None = None) -> Column:
        """Column of a window that the next ``stage`` or ``fetch`` computes; the same request is computed once."""
        key = (kind, str(c), str(k), share)
        if key not in self.asked:
            self.asked[key] = f"_roll{self.count}"
            self.count += 1
            self.open.append((self.asked[key], kind, col(c).cast("double"), k if isinstance(k, Column) else F.lit(k), share))
        return F.col(self.asked[key])

    def foresee(self, build: Callable[[], object]) -> "Pieces":
        """Runs ``build`` without its effects, to learn which windows it will ask of columns that are there already, and
        computes these together: one pass in place of one per stage."""
        self.dry = True
        build()
        self.dry = False
        there = set(self.df.columns)
        for key, name in list(self.asked.items()):
            if name not in there and key[1] not in there:
                del self.asked[key]
        names = set(self.asked.values())
        self.open = [x for x in self.open if x[0] in names]
        return self.fetch()

    def fetch(self) -> "Pieces":
        """Computes all open requests in one pass over each piece."""
        if not self.open:
            return self
        requests, extra = [], {}
        for name, kind, c, k, share in self.open:
            source, length = (next((n for n, e in extra.items() if str(e) == str(x)), None) for x in (c, k.cast("long")))
            if source is None:
                extra[source := f"_arg{len(extra)}"] = c
            if length is None:
                extra[length := f"_arg{len(extra)}"] = k.cast("long")
            requests.append((name, kind, source, length, share))
        self.open = []
        ship(self.df.sparkSession)
        df = self.df.withColumns(extra)
        schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name, *_ in requests)])
        self.df = df.groupBy(*self.part).applyInArrow(piece_windows(requests, self.pos, self.rows), schema).drop(*extra)
        return self

    def has(self, *names: str) -> bool:
        return set(names) <= set(self.df.columns)

    def close(self) -> DataFrame:
        self.fetch()
        keep = [c for c in self.df.columns if not c.startswith("_")]
        return self.df.filter("_core").select(*keep)

    def frame(self, a: int, b: int):
        return self.w0.rowsBetween(a, b)

    def back(self, k: int):
        return self.w0.rowsBetween(-(k - 1), 0)

    # -- row offsets
    def lag(self, c, k: int | Column = 1) -> Column:
        if isinstance(k, Column):
            return self.ask("lag", c, k)
        return F.lag(col(c), k).over(self.w0)

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(col(c), k).over(self.w0)

    def diff(self, c, k: int = 1) -> Column:
        return col(c) - self.lag(c, k)

    def pct(self, c, k: int = 1) -> Column:
        return ratio(c, self.lag(c, k)) - 1

    def nth_diff(self, c, n: int) -> Column:
        """n-th order difference, by binomial weights."""
        terms = [F.lit(float((-1) ** i * math.comb(n, i))) * (self.lag(c, i) if i else col(c)) for i in range(n + 1)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    # -- rolling frames with min_periods = window
    def full(self, c, k: int, expr: Column) -> Column:
        return F.when(F.count(col(c)).over(self.back(k)) == k, expr)

    def _roll(self, fn: Callable, c, k: int) -> Column:
        return self.full(c, k, fn(col(c)).over(self.back(k)))

    def mean(self, c, k):
        return self.ask("mean", c, k) if isinstance(k, Column) else self._roll(F.avg, c, k)

    def sum(self, c, k):
        return self.ask("sum", c, k) if isinstance(k, Column) else self._roll(F.sum, c, k)

    def min(self, c, k):
        return self.ask("min", c, k) if isinstance(k, Column) else self._roll(F.min, c, k)

    def max(self, c, k):
        return self.ask("max", c, k) if isinstance(k, Column) else self._roll(F.max, c, k)

    def std(self, c, k):
        return self.ask("std", c, k) if isinstance(k, Column) else self._roll(F.stddev_samp, c, k)

    def std0(self, c, k):
        return self._roll(F.stddev_pop, c, k)

    def var(self, c, k):
        return self._roll(F.var_samp, c, k)

    def quantile(self, c, q: float, k: int):
        return self.ask("quantile", c, k, q)

    def median(self, c, k):
        return self.quantile(c, 0.5, k)

    def tail_mean(self, c, q: float, k: int):
        """Mean of the window's values up to its quantile."""
        return self.ask("tail_mean", c, k, q)

    # -- moments of return-like columns (mean small against the deviation), from means of powers
    def vol(self, c, k: int) -> Column:
        """Sample deviation of returns.  Means of x and x*x cost a fraction of the general
        one-pass variance per frame row; for returns nothing cancels."""
        x, w = col(c), self.back(k)
        # every mention of a window value is computed anew: one mention each
        v = F.avg(x * x).over(w) - F.pow(F.avg(x).over(w), F.lit(2.0))
        return self.full(c, k, F.sqrt(F.greatest(v, F.lit(0.0)) * F.lit(k / (k - 1))))

    def moments(self, c: str, *ks: int) -> "Pieces":
        """Window means of the first four powers of returns, once for ``skew`` and ``kurt``."""
        x = F.col(c)
        self.stage(**{f"_{c}_2": x * x, f"_{c}_3": x * x * x, f"_{c}_4": x * x * x * x})
        source = {1: c, 2: f"_{c}_2", 3: f"_{c}_3", 4: f"_{c}_4"}
        self.stage(**{f"_{c}_{k}_m{p}": F.avg(n).over(self.back(k)) for k in ks for p, n in source.items()},
                   **{f"_{c}_{k}_n": F.count(c).over(self.back(k)) for k in ks})
        # a window of equal values has no shape
        m1, m2 = (lambda k: F.col(f"_{c}_{k}_m1")), (lambda k: F.col(f"_{c}_{k}_m2"))
        v = lambda k: m2(k) - m1(k) * m1(k)
        return self.stage(**{f"_{c}_{k}_v": F.when((F.col(f"_{c}_{k}_n") == k) & (v(k) > m2(k) * 1e-14), v(k)) for k in ks})

    def skew(self, c: str, k: int, bias: bool = False):
        """Skewness after ``moments``; bias-corrected unless asked otherwise."""
        m1, m2, m3, v = (F.col(f"_{c}_{k}_{x}") for x in ("m1", "m2", "m3", "v"))
        g = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (v * F.sqrt(v))
        return g if bias else g * F.lit(math.sqrt(k * (k - 1)) / (k - 2))

    def kurt(self, c: str, k: int):
        """Bias-corrected excess kurtosis after ``moments``."""
        m1, m2, m3, m4, v = (F.col(f"_{c}_{k}_{x}") for x in ("m1", "m2", "m3", "m4", "v"))
        g = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (v * v) - 3
        return ((k + 1) * g + 6) * F.lit((k - 1) / ((k - 2) * (k - 3)))

    def _pair(self, fn, a, b, k) -> Column:
        both = F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(1))
        over = self.back(k)
        value = fn(col(a), col(b), over) if fn is correlation else fn(col(a), col(b)).over(over)
        return F.when(F.count(both).over(over) == k, value)

    def corr(self, a, b, k):
        return self._pair(correlation, a, b, k)

    def cov(self, a, b, k):
        return self._pair(F.covar_samp, a, b, k)

    def autocorr(self, c, lagged, k: int, lag: int) -> Column:
        """Correlation with the own lag inside a k-row frame; ``lagged`` holds lag(c, lag)."""
        return self.full(c, k, correlation(col(c), col(lagged), self.back(k - lag)))

    def slope(self, c, k: int) -> Column:
        return self.full(c, k, F.regr_slope(col(c), F.col(self.pos).cast("double")).over(self.back(k)))

    def hits(self, cond: Column | str, k: int) -> Column:
        """Rolling count of a condition; an unknown condition counts as false."""
        return F.when(F.col(self.pos) >= k - 1, F.sum(flag(col(cond))).over(self.back(k))).cast("double")

    def hit_rate(self, cond: Column | str, k: int) -> Column:
        return self.hits(cond, k) / F.lit(float(k))

    def zscore(self, c, k: int) -> Column:
        w = self.back(k)
        return self.full(c, k, guarded(col(c) - F.avg(col(c)).over(w), F.stddev_samp(col(c)).over(w)))

    def ahead(self, fn, c, h: int) -> Column:
        """Aggregate over the next h rows, null unless all of them exist."""
        w = self.frame(1, h)
        return F.when(F.count(col(c)).over(w) == h, fn(col(c)).over(w))

    # -- decaying averages
    def _decayed(self, x: Column, alpha: float) -> Column:
        """sum alpha*(1-alpha)^age * x, by block-relative weights.

        Inside a block of rows the weights are powers of the position in the block, so a
        running sum per block and the total of the previous block are enough; rows
        further back than one block weigh less than double precision (checked by ``ewm``).
        """
        r = 1.0 - alpha
        j = (F.col(self.pos) % self.block).cast("double")
        w = x * F.pow(F.lit(r), -j)
        cur = F.sum(w).over(Window.partitionBy(*self.part, "_blk").orderBy(self.pos)
                            .rowsBetween(Window.unboundedPreceding, 0))
        prev = F.sum(w).over(Window.partitionBy(*self.part).orderBy("_blk").rangeBetween(-1, -1))
        return F.lit(alpha) * (
            F.coalesce(cur, F.lit(0.0)) * F.pow(F.lit(r), j)
            + F.coalesce(prev, F.lit(0.0)) * F.pow(F.lit(r), j + self.block)
        )

    def _check(self, alpha: float) -> None:
        need = math.log(1e-15) / math.log(1 - alpha)
        if need > min(self.block, self.halo) or -self.block * math.log(1 - alpha) > 600:
            raise ValueError(f"block {self.block} or halo {self.halo} does not fit decay {alpha}")

    def ewm(self, c, span: float, adjust: bool = True) -> Column:
        alpha = 2.0 / (span + 1)
        self._check(alpha)
        x = col(c).cast("double")
        if adjust:
            norm = 1 - F.pow(F.lit(1 - alpha), (F.col(self.pos) + 1).cast("double"))
            return F.when(x.isNotNull(), self._decayed(x, alpha) / norm)
        seeded = F.when(F.col(self.pos) == 0, x / alpha).otherwise(x)
        return F.when(x.isNotNull(), self._decayed(seeded, alpha))

    def wilder(self, c, seed, period: int) -> Column:
        """Smoothing with factor 1/period from the mean of the first ``period`` changes.

        ``seed`` holds the rolling mean of ``c``; changes start at position 1.
        """
        alpha = 1.0 / period
        self._check(alpha)
        p = F.col(self.pos)
        x = F.when(p == period, col(seed) / alpha).when(p > period, col(c)).otherwise(F.lit(0.0))
        return F.when(p >= period, self._decayed(x, alpha))

    # -- running values across pieces, from the rows of the series themselves
    def running_from(self, raw: DataFrame, **specs: tuple[str, Column]) -> "Pieces":
        """Running sum or max over the whole series, valid on core rows.

        ``raw`` is the series before it was cut.  The state before each piece comes from a partial aggregate over
        it, so rows are shuffled once, to their pieces, whatever is computed there.
        """
        raw = raw.withColumn("_piece", F.floor(F.col(self.pos) / self.rows).cast("long"))
        before = carries(raw, self.keys, {f"_c_{n}": spec for n, spec in specs.items()})
        self.df = self.df.join(before, self.part, "left")
        self.stage(**{n: self.merged(kind, F.col(f"_c_{n}"), self.inside(kind, expr)) for n, (kind, expr) in specs.items()})
        self.df = self.df.drop(*[f"_c_{n}" for n in specs])
        return self

    def inside(self, kind: str, expr: Column) -> Column:
        """Running value over the core rows of the piece."""
        fn = F.sum if kind == "sum" else F.max
        return fn(F.when(F.col("_core"), expr)).over(self.w0.rowsBetween(Window.unboundedPreceding, 0))

    @staticmethod
    def merged(kind: str, before: Column, here: Column) -> Column:
        """A state before a piece and one inside it."""
        if kind == "sum":
            return F.coalesce(before, F.lit(0.0)) + F.coalesce(here, F.lit(0.0))
        return F.greatest(before, here)

    # -- expanding values across pieces
    def expanding(self, **specs: tuple[str, Column]) -> "Pieces":
        """Running sum / max / last over the whole series, valid on core rows and on the
        nearer half of the halo (so that later stages can roll over the result)."""
        if self.dry:
            return self
        warm = self.halo // 2
        p, piece = F.col(self.pos), F.col("_piece")
        usable = p >= piece * self.rows - warm
        tail = (p >= (piece + 1) * self.rows - warm).cast("int")
        values, aggs, prefix = {}, [], []
        upto = Window.partitionBy(*self.keys).orderBy("_piece", "_tail")
        for name, (kind, expr) in specs.items():
            if kind == "last":
                expr = F.when(expr.isNotNull(), F.struct(p.alias("p"), expr.alias("v")))
            fn = F.sum if kind == "sum" else F.max
            values[f"_x_{name}"] = expr
            aggs.append(fn(f"_x_{name}").alias(f"_s_{name}"))
            prefix.append(fn(f"_s_{name}").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_c_{name}"))
        df = self.df.withColumns(values)
        carry = (
            df.filter("_core").withColumn("_tail", tail).groupBy(*self.keys, "_piece", "_tail").agg(*aggs)
            .select(*self.keys, "_piece", "_tail", *prefix).filter("_tail = 0")
            .withColumn("_piece", F.col("_piece") + 1).drop("_tail")
        )
        df = df.join(carry, [*self.keys, "_piece"], "left")
        w = self.w0.rowsBetween(Window.unboundedPreceding, 0)
        out = {}
        for name, (kind, expr) in specs.items():
            x = F.col(f"_x_{name}")
            if kind == "sum":
                here = F.coalesce(F.sum(F.when(usable, x)).over(w), F.lit(0.0))
                out[name] = F.when(x.isNotNull() & usable, F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) + here)
            else:
                best = F.greatest(F.col(f"_c_{name}"), F.max(F.when(usable, x)).over(w))
                out[name] = F.when(usable, best["v"] if kind == "last" else best)
        self.df = df.withColumns(out).drop(*[f"_c_{n}" for n in specs], *[f"_x_{n}" for n in specs])
        return self


def hashed_uniform(seed: int, *keys: str) -> Column:
    """A uniform value in (0, 1) that depends on the keys alone, so it is the same on every cluster."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def hashed_normal(seed: int, *keys: str) -> Column:
    """A standard normal value that depends on the keys alone."""
    return F.sqrt(-2 * F.log(hashed_uniform(seed, *keys))) * F.cos(2 * math.pi * hashed_uniform(seed + 7919, *keys))
