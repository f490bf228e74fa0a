"""Query registry and the table bindings the queries share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its comparison SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, only: Iterable[str] | None = None, **special: int) -> DataFrame:
    """Round double columns, so that summation order cannot show."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float") and (only is None or n in set(only))]
    return df.withColumns({n: F.round(F.col(n).cast("double"), special.get(n, digits)) for n in doubles})


# ---------------------------------------------------------------- bindings


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """events as ticks: the event type is the symbol."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
        (F.col("user_id") % 2 == 1).alias("is_buyer_maker"), F.col("event_id").alias("id"))


def trade_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as ticks: the supplier is the symbol, the unit price the price."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
        (F.col("l_returnflag") == "R").alias("is_buyer_maker"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("id"))


def hourly(spark, sf):
    return B.resample(event_ticks(spark, sf), "1h")


def daily(spark, sf, last=None):
    return B.resample(trade_ticks(spark, sf), "1d", last=last)


# ---------------------------------------------------------------- comparison SQL pieces

EVENT_TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty,
         user_id % 2 = 1 AS maker, event_id AS id FROM events)"""

TRADE_TICKS = """ticks AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS qty, l_returnflag = 'R' AS maker,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS id FROM lineitem)"""


def bars_sql(ticks: str, width: int) -> str:
    """CTEs ending in ``bars(symbol, ts, pos, n, open..trades_count)``, every bin present."""
    return f"""{ticks}, agg AS (
  SELECT symbol, CAST(floor(epoch(ts) / {width}) AS BIGINT) AS bin, arg_min(price, (ts, id)) AS o, max(price) AS h,
         min(price) AS l, arg_max(price, (ts, id)) AS c, sum(qty) AS v,
         sum(CASE WHEN maker THEN 0 ELSE qty END) AS bv, sum(CASE WHEN maker THEN qty ELSE 0 END) AS sv, count(*) AS k
  FROM ticks GROUP BY 1, 2),
span AS (SELECT symbol, min(bin) AS lo, max(bin) AS hi FROM agg GROUP BY 1),
spine AS (SELECT symbol, lo, hi, unnest(range(lo, hi + 1)) AS bin FROM span),
bars AS (
  SELECT s.symbol, make_timestamp(s.bin * {width} * 1000000) AS ts, s.bin - s.lo AS pos, s.hi - s.lo + 1 AS n,
         last_value(o IGNORE NULLS) OVER w AS open, last_value(h IGNORE NULLS) OVER w AS high,
         last_value(l IGNORE NULLS) OVER w AS low, last_value(c IGNORE NULLS) OVER w AS close,
         coalesce(v, 0) AS volume, coalesce(bv, 0) AS buy_volume, coalesce(sv, 0) AS sell_volume,
         coalesce(k, 0) AS trades_count
  FROM spine s LEFT JOIN agg a ON a.symbol = s.symbol AND a.bin = s.bin
  WINDOW w AS (PARTITION BY s.symbol ORDER BY s.bin))"""


HOURLY = bars_sql(EVENT_TICKS, 3600)
DAILY = bars_sql(TRADE_TICKS, 86400)


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded output column; adding 0.0 turns a negative zero into zero."""
    return f"CAST(round({expr}, {digits}) AS DOUBLE) + 0.0 AS {name}"
