"""Bars, time joins, discovery and row filters: A1-A3, J1-J14, P1-P11, O1-O3, S-readers over derived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.operators import asof
from marketspark.operators import bars as B
from marketspark.operators import quality, splits
from marketspark.operators.features import clean
from marketspark.session import shared_folder
from marketspark.sources import files
from workload.registry import (DAILY, EVENT_TICKS, HOURLY, bars_sql, daily, event_ticks, hourly, query, r, rounded, table)
from workload.sqltext import W, corr, pct, ratio, staged

NUM = ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume")


def cols(digits=6, label="ts"):
    return f"symbol, {label} AS ts, pos, n, " + ", ".join(r(c, c, digits) for c in NUM) + ", CAST(trades_count AS BIGINT) AS trades_count"


@query("bars_hourly", f"WITH {HOURLY} SELECT {cols()} FROM bars")
def bars_hourly(spark, sf):
    return rounded(hourly(spark, sf))


@query("bars_daily_trades", f"WITH {DAILY} SELECT {cols(8)} FROM bars")
def bars_daily(spark, sf):
    return rounded(daily(spark, sf), 8)


for _tf in ("1m", "5m", "15m", "30m", "4h", "12h"):
    def _bars(spark, sf, tf=_tf):
        return rounded(B.resample(event_ticks(spark, sf), tf))

    query(f"bars_{_tf}", f"WITH {bars_sql(EVENT_TICKS, B.TIMEFRAMES[_tf])} SELECT {cols()} FROM bars")(_bars)

# weeks run Monday to Sunday and carry their Sunday; three-day bins count from the first day of each symbol
WEEKLY = bars_sql(EVENT_TICKS.replace("SELECT event_type AS symbol, ts,", "SELECT event_type AS symbol, ts - INTERVAL 4 DAY AS ts,"), 7 * 86_400)
THREE_DAY = bars_sql(EVENT_TICKS.replace("SELECT event_type AS symbol, ts,", """SELECT event_type AS symbol,
  make_timestamp(CAST(epoch_us(ts) - epoch_us(date_trunc('day', min(ts) OVER (PARTITION BY event_type))) AS BIGINT)) AS ts,"""), 3 * 86_400)


@query("bars_1w", f"WITH {WEEKLY} SELECT {cols(label='ts + INTERVAL 10 DAY')} FROM bars")
def bars_week(spark, sf):
    return rounded(B.resample(event_ticks(spark, sf), "1w"))


@query("bars_3d", f"WITH {THREE_DAY}, d AS (SELECT event_type AS s, date_trunc('day', min(ts)) AS d0 FROM events GROUP BY 1), "
                  f"b2 AS (SELECT bars.*, d0 FROM bars JOIN d ON d.s = bars.symbol) SELECT {cols(label='d0 + to_microseconds(epoch_us(ts))')} FROM b2")
def bars_three_days(spark, sf):
    return rounded(B.resample(event_ticks(spark, sf), "3d"))


@query("bars_sparse", f"WITH {HOURLY} SELECT symbol, ts, " + ", ".join(r(c, c) for c in NUM) + ", CAST(trades_count AS BIGINT) AS trades_count FROM bars WHERE trades_count > 0")
def bars_sparse(spark, sf):
    return rounded(B.sparse_bars(event_ticks(spark, sf), "1h"))


# ------------------------------------------------------------------ as-of family

#: orders per priority as an irregular fact series with holes; bars are the hourly event bars moved to its years
FACTS = """facts AS (SELECT CASE event_type WHEN 'click' THEN 'purchase' ELSE event_type END AS symbol, ts, event_id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS fv, value * 2 AS gv FROM events)"""
ASOF = "WITH " + HOURLY + ", " + FACTS + """, latest AS (SELECT symbol, ts, arg_max(ROW(fv, gv), event_id) AS f FROM facts GROUP BY 1, 2),
 picked AS (SELECT b.symbol, b.ts, b.pos, b.close, (l.f)[1] AS fv, (l.f)[2] AS gv FROM bars b ASOF LEFT JOIN latest l ON b.symbol = l.symbol AND b.ts >= l.ts)"""


def facts(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("event_type") == "click", "purchase").otherwise(F.col("event_type")).alias("symbol"), "ts", "event_id",
                    F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("fv"), (F.col("value") * 2).alias("gv"))


@query("asof_raw", ASOF + f" SELECT symbol, ts, {r('close', 'close')}, {r('fv', 'fv')}, {r('gv', 'gv')} FROM picked")
def asof_raw(spark, sf):
    out = asof.asof(hourly(spark, sf), [asof.Facts(facts(spark, sf), ["fv", "gv"])], fill=False, tie="event_id", bucket_rows=1000)
    return rounded(out.select("symbol", "ts", "close", "fv", "gv"))


@query("asof_filled", ASOF + f""" SELECT symbol, ts, round(coalesce(last_value(fv IGNORE NULLS) OVER ({W}), 0), 6) + 0.0 AS fv,
  round(coalesce(last_value(gv IGNORE NULLS) OVER ({W}), 1), 6) + 0.0 AS gv FROM picked""")
def asof_filled(spark, sf):
    f = asof.Facts(facts(spark, sf), ["fv", "gv"], {"fv": 0.0, "gv": 1.0})
    return rounded(asof.asof(hourly(spark, sf), [f], tie="event_id", bucket_rows=1000).select("symbol", "ts", "fv", "gv"))


def _family(spark, sf, minutes, **cols_):
    """All events as facts of one family, some minutes late; the last of each time counts."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), "ts").agg(F.max_by("value", "event_id").alias("value"))
    return e.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTE")).alias("ts"), *[F.expr(x).alias(n) for n, x in cols_.items()])


FAMILY_SQL = "WITH " + HOURLY + ", last AS (SELECT event_type AS symbol, ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)" + "".join(
    f""", {n} AS (SELECT symbol, ts + INTERVAL {k} MINUTE AS ts, {c} FROM last),
  j_{n} AS (SELECT b.symbol, b.ts, {', '.join(f'f.{x}' for x in names)} FROM bars b ASOF LEFT JOIN {n} f ON b.symbol = f.symbol AND b.ts >= f.ts)""" for n, k, c, names in (
    ("funding", 7, "value / 1000 AS funding_rate", ["funding_rate"]),
    ("oi", 11, "value * 10 AS sum_open_interest, value * 20 AS sum_open_interest_value", ["sum_open_interest", "sum_open_interest_value"]),
    ("mark", 0, "value AS mark_close", ["mark_close"])))


@query("asof_derivatives", FAMILY_SQL + f""" SELECT b.symbol, b.ts, {r('coalesce(funding_rate, 0)', 'funding_rate')}, {r('coalesce(sum_open_interest, 0)', 'sum_open_interest')},
  {r('coalesce(sum_open_interest_value, 0)', 'sum_open_interest_value')}, {r('mark_close', 'mark_close')}, {r('(close - mark_close) / mark_close * 100', 'basis')}
  FROM bars b JOIN j_funding USING (symbol, ts) JOIN j_oi USING (symbol, ts) JOIN j_mark USING (symbol, ts)""")
def asof_derivatives(spark, sf):
    fam = {"funding": _family(spark, sf, 7, funding_rate="value / 1000"),
           "open_interest": _family(spark, sf, 11, sum_open_interest="value * 10", sum_open_interest_value="value * 20"), "mark": _family(spark, sf, 0, mark_close="value")}
    out = asof.with_derivatives(hourly(spark, sf), fam)
    return rounded(out.select("symbol", "ts", "funding_rate", "sum_open_interest", "sum_open_interest_value", "mark_close", "basis"))


@query("asof_zero_fill", FAMILY_SQL + f""" SELECT b.symbol, b.ts, {r('coalesce(funding_rate, 0)', 'funding_rate')}, {r('coalesce(sum_open_interest, 0)', 'sum_open_interest')}
  FROM bars b JOIN j_funding USING (symbol, ts) JOIN j_oi USING (symbol, ts)""")
def asof_zero(spark, sf):
    fam = {"funding": _family(spark, sf, 7, funding_rate="value / 1000"), "open_interest": _family(spark, sf, 11, sum_open_interest="value * 10"), "mark": _family(spark, sf, 0, mark_close="value")}
    return rounded(asof.with_derivatives(hourly(spark, sf), fam, mode="zero").select("symbol", "ts", "funding_rate", "sum_open_interest"))


@query("join_exact_time_fill", "WITH " + HOURLY + f""", f AS (SELECT symbol, min(ts) AS ts, sum(volume) * 2 AS fv FROM bars GROUP BY symbol, pos // 8)
  SELECT b.symbol, b.ts, round(coalesce(last_value(fv IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0), 6) + 0.0 AS fv FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.ts = b.ts""")
def join_exact(spark, sf):
    b = hourly(spark, sf)
    f = b.groupBy("symbol", F.floor(F.col("pos") / 8)).agg(F.min("ts").alias("ts"), (F.sum("volume") * 2).alias("fv")).select("symbol", "ts", "fv")
    return rounded(asof.exact_join_fill(b, f, ["fv"], 0.0).select("symbol", "ts", "fv"))


BENCH = HOURLY + f""", base AS (SELECT ts, {ratio('close', 'lag(close) OVER (ORDER BY ts)')} - 1 AS btc_return FROM bars WHERE symbol = 'view'),
  j AS (SELECT b.*, coalesce(btc_return, 0) AS btc_return FROM bars b LEFT JOIN base ON base.ts = b.ts)"""


@query("join_benchmark_relation", staged(BENCH, [{"ret": pct("close")}, {"btc_corr_10": corr("ret", "btc_return", 10), "btc_corr_20": corr("ret", "btc_return", 20),
    "relative_strength": f"(CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN avg(ret) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - avg(btc_return) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END)",
    "btc_beta": f"(CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN covar_samp(ret, btc_return) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / (var_samp(btc_return) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 1e-10) END)"}],
    ["btc_return", "btc_corr_10", "btc_corr_20", "relative_strength", "btc_beta"], source="j"))
def join_benchmark(spark, sf):
    from marketspark.operators.features.base import begin
    from marketspark.operators.features.intraday import benchmark_relation

    b = hourly(spark, sf)
    s = begin(asof.join_benchmark(b, asof.benchmark_returns(b, "view")), halo=64, block=64)
    return rounded(benchmark_relation(s).close().select("symbol", "ts", "btc_return", "btc_corr_10", "btc_corr_20", "relative_strength", "btc_beta"))


@query("join_benchmark_live", "WITH " + HOURLY + f""", base AS (SELECT ts + INTERVAL 30 MINUTE AS ts, {ratio('close', 'lag(close) OVER (ORDER BY ts)')} - 1 AS btc_return FROM bars WHERE symbol = 'view')
  SELECT b.symbol, b.ts, {r('base.btc_return', 'btc_return')} FROM bars b ASOF LEFT JOIN base ON b.ts >= base.ts""")
def join_benchmark_live(spark, sf):
    b = hourly(spark, sf)
    base = b.filter("symbol = 'view'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTE"))  # known half an hour later
    return rounded(asof.join_benchmark(b, asof.benchmark_returns(base, "view"), live=True).select("symbol", "ts", "btc_return"))


PAIR = HOURLY + """, other AS (SELECT ts, close AS bc FROM bars WHERE symbol = 'view'), j AS (SELECT b.symbol, b.ts, b.close, bc FROM bars b JOIN other o ON o.ts = b.ts),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM j)"""


@query("join_rolling_corr", staged(PAIR, [{"a": pct("close"), "b": pct("bc")}, {"corr": corr("a", "b", 24)}], ["corr"], source="k"))
def join_rolling(spark, sf):
    return rounded(asof.rolling_pair_corr(hourly(spark, sf), "view").select("symbol", "ts", "corr"))


LAST24 = """ret AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)"""


@query("pairs_correlation", "WITH " + DAILY + f""", {LAST24} SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, round(coalesce(corr(a.x, b.x), 0), 6) + 0.0 AS corr
  FROM ret a JOIN ret b ON a.k = b.k AND a.symbol < b.symbol AND a.k <= 24 GROUP BY 1, 2""")
def pairs_correlation(spark, sf):
    return rounded(asof.pair_correlations(asof.last_returns(daily(spark, sf, last=25))))


@query("last_window_returns", "WITH " + DAILY + f""", {LAST24} SELECT symbol, count(*) AS k, {r('sum(x)', 'total')}, {r('stddev_samp(x)', 'sd')} FROM ret WHERE k <= 24 GROUP BY 1""")
def last_window(spark, sf):
    a = asof.last_returns(daily(spark, sf, last=25)).select("symbol", F.explode("r").alias("x"))
    return rounded(a.groupBy("symbol").agg(F.count("x").alias("k"), F.sum("x").alias("total"), F.stddev_samp("x").alias("sd")))


# ------------------------------------------------------------------ latest row, filters, statistics


@query("latest_row_per_symbol", staged(DAILY, [{"ret": pct("close")}, {
    "v20": f"CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN stddev_samp(ret) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END",
    "v100": f"CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 100 THEN stddev_samp(ret) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) END"}],
    ["close", "v20", "v100"], where="WHERE pos = n - 1", digits={"close": 8}))
def latest_row(spark, sf):
    from marketspark.plans.signals import latest_market

    m = latest_market(daily(spark, sf, last=101))
    return rounded(m.select("symbol", "ts", F.col("price").alias("close"), F.col("volatility").alias("v20"), F.col("avg_volatility").alias("v100")), close=8)


@query("dataset_statistics", f"WITH {HOURLY}, {bars_sql(EVENT_TICKS.replace('ticks AS', 'ticks4 AS'), 14_400).replace(' FROM ticks GROUP', ' FROM ticks4 GROUP').replace('agg AS', 'agg4 AS').replace('FROM agg ', 'FROM agg4 ').replace('JOIN agg ', 'JOIN agg4 ').replace('span AS', 'span4 AS').replace('FROM span)', 'FROM span4)').replace('spine AS', 'spine4 AS').replace('FROM spine ', 'FROM spine4 ').replace('bars AS', 'bars4 AS')},"
       " u AS (SELECT '1h' AS timeframe, symbol, ts FROM bars UNION ALL SELECT '4h', symbol, ts FROM bars4)"
       " SELECT coalesce(timeframe, 'TOTAL') AS timeframe, count(DISTINCT symbol) AS symbols, count(*) AS \"rows\", min(ts) AS first_ts, max(ts) AS last_ts FROM u GROUP BY ROLLUP (timeframe)")
def dataset_statistics(spark, sf):
    t = event_ticks(spark, sf)
    u = B.resample(t, "1h").withColumn("timeframe", F.lit("1h")).unionByName(B.resample(t, "4h").withColumn("timeframe", F.lit("4h")))
    return quality.dataset_statistics(u)


@query("filter_minimum_history", "WITH " + DAILY + " SELECT symbol, max(n) AS n, count(*) AS k FROM bars WHERE n > 2400 GROUP BY 1")
def filter_history(spark, sf):
    return splits.minimum_history(daily(spark, sf), 2400).groupBy("symbol").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))


@query("filter_null_and_bad", """SELECT doc_id, round(coalesce(x, 0), 6) + 0.0 AS x FROM (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 5 = 0 THEN 0.0 ELSE n_chars / 100.0 END AS x FROM documents)""")
def filter_bad(spark, sf):
    d = table(spark, sf, "documents")
    x = F.when(F.col("n_chars") % 7 == 0, F.lit(float("nan"))).when(F.col("n_chars") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("n_chars") / 100.0)
    return rounded(clean.zero_bad(d.select("doc_id", x.alias("x")), ["x"]))


@query("symbol_search", "SELECT DISTINCT upper(p_name) AS symbol FROM part WHERE contains(upper(p_name), 'RED') ORDER BY 1 LIMIT 50")
def symbol_search(spark, sf):
    p = table(spark, sf, "part").select(F.upper("p_name").alias("symbol")).distinct()
    return p.filter(F.col("symbol").contains("RED")).orderBy("symbol").limit(50)


@query("dedupe_first_by_key", """SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_suppkey, l_partkey, l_extendedprice)) AS l_partkey, count(*) AS copies FROM lineitem GROUP BY 1, 2""")
def dedupe(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice")
    first = files.first_by_id(l, ("l_orderkey", "l_linenumber"), ("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice"))
    n = l.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))
    return first.join(n, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "copies")


@query("stitch_history_pages", "WITH " + HOURLY + f""", u AS (SELECT symbol, ts, close, 2 AS page FROM bars WHERE pos < 400 UNION ALL SELECT symbol, ts, close + 1, 1 FROM bars WHERE pos >= 300)
  SELECT symbol, ts, {r('arg_min(close, page)', 'close')} FROM u GROUP BY 1, 2""")
def stitch(spark, sf):
    b = hourly(spark, sf).select("symbol", "ts", "pos", "close")
    u = b.filter("pos < 400").select("symbol", "ts", "close", F.lit(2).alias("page")).unionByName(b.filter("pos >= 300").select("symbol", "ts", (F.col("close") + 1).alias("close"), F.lit(1).alias("page")))
    return rounded(files.stitch_pages(u, ("symbol", "ts")))


# ------------------------------------------------------------------ files


def write_by_symbol(df, base, name, shapes):
    """One CSV folder a symbol; ``shapes`` change the columns or the options of single symbols."""
    symbols = sorted(x["symbol"] for x in df.select("symbol").distinct().collect())  # five event types
    for i, symbol in enumerate(symbols):
        one = df.filter(F.col("symbol") == symbol)
        one, options = shapes[i](one) if i < len(shapes) else (one.drop("symbol"), {})
        one.write.csv(f"{base}/{name(symbol)}", header=True, **options)
    return base


def _new(spark, kind):
    import uuid

    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _kline_files(spark, sf):
    """Hourly bars as one file a symbol: one without the last columns, one with a text column first and all cells quoted."""
    b = hourly(spark, sf).select(
        "symbol", F.unix_millis("ts").alias("timestamp"), "open", "high", "low", "close", "volume", (F.col("volume") * F.col("close")).alias("quote_volume"), F.col("trades_count").alias("trades"),
        F.col("buy_volume").alias("taker_buy_volume"), F.lit("usdt_m").alias("market_type"))
    return write_by_symbol(b, _new(spark, "klines"), lambda x: f"klines_usdt_m_{x.upper()}USDT_1h.csv", [
        lambda d: (d.drop("symbol", "quote_volume", "market_type"), {}), lambda d: (d, {"quoteAll": True})])


@query("scan_klines_drifting_header", "WITH " + HOURLY + f""" SELECT upper(symbol) || 'USDT' AS symbol, '1h' AS timeframe, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')},
  {r('volume', 'volume')}, CASE WHEN symbol = (SELECT min(symbol) FROM bars) THEN NULL ELSE round(volume * close, 6) + 0.0 END AS quote_volume, CAST(trades_count AS BIGINT) AS trades,
  {r('buy_volume', 'taker_buy_volume')}, {r('buy_volume / (volume + 1e-10)', 'buy_ratio')} FROM bars""")
def scan_klines(spark, sf):
    base = _kline_files(spark, sf)
    return rounded(files.scan_klines(spark, base).drop("taker_buy_quote_volume"))


@query("discover_symbols", """SELECT DISTINCT 'klines' AS family, upper(event_type) || 'USDT' AS symbol, '1h' AS timeframe FROM events""")
def discover(spark, sf):
    return files.discover(spark, _kline_files(spark, sf))


@query("file_inventory", "SELECT 'klines' AS family, count(DISTINCT event_type) AS files FROM events")
def inventory(spark, sf):
    return files.inventory(spark, _kline_files(spark, sf)).select("family", "files")


@query("data_version", """SELECT n AS files, substr(md5(concat_ws(',', n, a, b)), 1, 12) AS version FROM (
  SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS VARCHAR) AS b
  FROM (SELECT md5(p_name || CAST(p_partkey AS VARCHAR)) AS h FROM part))""")
def data_version(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"))
    return files.data_version(p)


#: Column and value of each side family, all from one number; the last is missing in the first symbol's file.
SIDE = {
    "funding_rate": {"funding_rate": "value / 1000 - 0.05", "mark_price": "value * 10"},
    "open_interest": {"sum_open_interest": "value * 100", "sum_open_interest_value": "value * 1000"},
    "long_short_ratio": {"long_short_ratio": "value / 10", "long_account": "value / 100", "short_account": "1 - value / 100"},
    "taker_volume": {"buy_sell_ratio": "value / 7", "buy_vol": "value * 3", "sell_vol": "value * 2"},
    "mark_price": {"open": "value", "high": "value + 1", "low": "value - 1", "close": "value - 0.5"},
    "premium_index": {"open": "-value", "high": "1 - value", "low": "-1 - value", "close": "-0.5 - value"},
}


def _side_sql(family):
    *most, last = SIDE[family]
    out = {n: f"{files.PREFIX[family]}_{n}" if family in files.PREFIX else n for n in SIDE[family]}
    values = [r(SIDE[family][n], out[n]) for n in most] + [f"CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN NULL ELSE round({SIDE[family][last]}, 6) + 0.0 END AS {out[last]}"]
    return f"SELECT upper(event_type) || 'USDT' AS symbol, date_trunc('millisecond', ts) AS ts, {', '.join(values)} FROM events"


def _side_files(spark, sf, family):
    """A file a symbol: one without the last column, one with a text column first and all cells quoted, one turned around."""
    time = "funding_time" if family == "funding_rate" else "timestamp"
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.unix_millis("ts").alias(time), *[F.expr(x).alias(n) for n, x in SIDE[family].items()])
    last = list(SIDE[family])[-1]
    return write_by_symbol(e, _new(spark, family), lambda x: f"{family}_usdt_m_{x.upper()}USDT.csv", [
        lambda d: (d.drop("symbol", last), {}), lambda d: (d, {"quoteAll": True}), lambda d: (d.select(*reversed(d.columns)), {})])


def _scan_side(family):
    @query(f"scan_{family}", _side_sql(family))
    def scan(spark, sf):
        return rounded(files.scan_family(spark, _side_files(spark, sf, family), family))


for _side in SIDE:
    _scan_side(_side)


@query("scan_one_series", "WITH " + HOURLY + f""" SELECT upper(symbol) || 'USDT' AS symbol, ts, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close, {r('volume', 'volume')} FROM bars WHERE symbol = (SELECT max(symbol) FROM bars)""")
def scan_one(spark, sf):
    last = hourly(spark, sf).agg(F.max("symbol")).first()[0]
    df = files.scan_klines(spark, _kline_files(spark, sf), f"{last.upper()}USDT", "1h", narrow=True)
    return rounded(df.select("symbol", "ts", F.col("close").cast("double").alias("close"), "volume"), only=["volume"])


TICK_ROWS = f"SELECT event_type AS symbol, event_id AS id, {r('value', 'price')}, date_trunc('millisecond', ts) AS ts, user_id % 2 = 1 AS is_buyer_maker FROM events"


def _tick_csv(spark, sf):
    """Tick files of two headers, one of them quoted, and a second file of each symbol that repeats some trades."""
    e = event_ticks(spark, sf).select("symbol", "id", "price", "qty", F.lit(None).cast("double").alias("base_qty"), F.unix_millis("ts").alias("time"), "is_buyer_maker")
    base = write_by_symbol(e, _new(spark, "ticks"), lambda x: f"{x}_trades.csv", [
        lambda d: (d.select(*reversed(d.columns)), {}), lambda d: (d, {"quoteAll": True})])
    again = e.filter("id % 10 = 0").withColumn("time", F.col("time") + 5)
    write_by_symbol(again, base, lambda x: f"{x}_more.csv", [])
    return base


@query("scan_ticks_by_name", TICK_ROWS)
def scan_ticks(spark, sf):
    return rounded(files.first_by_id(files.scan_ticks(spark, f"{_tick_csv(spark, sf)}/*.csv")).select("symbol", "id", "price", "ts", "is_buyer_maker"))


@query("stream_ticks_any_header", TICK_ROWS)
def stream_ticks(spark, sf):
    """The same files as a stream of arriving files, a few to a batch."""
    landed = _new(spark, "landed")
    files.land_ticks(spark, f"{_tick_csv(spark, sf)}/*.csv", landed, landed + "-checkpoint", files_per_trigger=3).awaitTermination()
    return rounded(files.first_by_id(spark.read.parquet(landed).drop("batch")).select("symbol", "id", "price", "ts", "is_buyer_maker"))


@query("parse_raw_klines", "WITH " + HOURLY + f""" SELECT symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}, CAST(trades_count AS BIGINT) AS trades FROM bars WHERE pos % 50 <> 7""")
def parse_raw(spark, sf):
    b = hourly(spark, sf)
    cell = lambda x: F.col(x).cast("string")
    bad = F.when(F.col("pos") % 50 == 7, F.lit("n/a")).otherwise(cell("close"))
    row = F.array(F.unix_millis("ts").cast("string"), cell("open"), cell("high"), cell("low"), bad, cell("volume"), F.lit("0"), cell("volume"), cell("trades_count"), cell("buy_volume"), cell("buy_volume"), F.lit("0"))
    payload = b.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(row)).alias("payload")).drop("d")
    return rounded(files.parse_klines(payload).select("symbol", "ts", "open", "high", "low", "close", "volume", "trades"))


@query("parse_raw_funding", f"SELECT event_type AS symbol, ts, {r('value / 1000', 'funding_rate')} FROM (SELECT event_type, date_trunc('millisecond', ts) AS ts, value FROM events)")
def parse_funding(spark, sf):
    e = table(spark, sf, "events")
    obj = F.struct(F.unix_millis("ts").cast("string").alias("fundingTime"), (F.col("value") / 1000).cast("string").alias("fundingRate"))
    payload = e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(obj)).alias("payload")).drop("d")
    return rounded(files.parse_derivatives(payload, "funding"))


@query("relaxed_union", f"SELECT 'o' AS symbol, {r('CAST(o_orderkey AS DOUBLE)', 'k')}, {r('o_totalprice', 'v')}, CAST(NULL AS DOUBLE) AS q FROM orders UNION ALL SELECT 'l', {r('CAST(l_orderkey AS DOUBLE)', 'k')}, {r('l_extendedprice', 'v')}, {r('l_quantity', 'q')} FROM lineitem")
def relaxed(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("o").alias("symbol"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("string").alias("v"))
    l = table(spark, sf, "lineitem").select(F.lit("l").alias("symbol"), F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").cast("float").alias("q"))
    return rounded(files.relaxed_union([o, l]))


@query("prediction_log_lines", "SELECT 'INFO' AS level, 'engine' AS logger, count(*) AS n, sum(length(o_orderstatus)) AS k FROM orders GROUP BY ALL")
def log_lines(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parsed = files.log_lines(o).withColumn("m", F.from_json("message", "o_orderkey long, o_orderstatus string, o_totalprice double"))
    return parsed.groupBy("level", "logger").agg(F.count("m.o_orderkey").alias("n"), F.sum(F.length("m.o_orderstatus")).alias("k"))


@query("bars_sink_round_trip", f"WITH {HOURLY} SELECT symbol, '1h' AS timeframe, ts, {r('close', 'close')} FROM bars")
def sink_round_trip(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    files.write_bars(hourly(spark, sf).withColumn("timeframe", F.lit("1h")), path)
    return rounded(files.read_bars(spark, path).select("symbol", "timeframe", "ts", "close"))


@query("snapshot_latest", f"WITH {HOURLY} SELECT symbol, ts, round(close + 1, 6) + 0.0 AS close FROM bars")
def snapshot_latest(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/snap-{uuid.uuid4().hex}"
    b = hourly(spark, sf).select("symbol", "ts", "close").withColumn("interval", F.lit("1h"))
    files.write_snapshot(b, path, "20240101")
    files.write_snapshot(b.withColumn("close", F.col("close") + 1), path, "20240102")
    return rounded(files.read_snapshot(spark, path).select("symbol", "ts", "close"))



@query("bars_csv_round_trip", f"WITH {HOURLY} SELECT symbol, '1h' AS timeframe, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}, CAST(trades_count AS BIGINT) AS trades_count FROM bars")
def csv_round_trip(spark, sf):
    """The CSV form of the bar sink, read back by its header with types."""
    path = _new(spark, "bars-csv")
    files.write_bars(hourly(spark, sf).withColumn("timeframe", F.lit("1h")).drop("pos", "n"), path, "csv")
    kinds = {"ts": "timestamp", **dict.fromkeys(("open", "high", "low", "close", "volume"), "double"), "trades_count": "long"}
    back = files.read_by_header(spark, f"{path}/timeframe=*/symbol=*", kinds)
    part = lambda n: F.regexp_extract("path", f"/{n}=([^/]+)/", 1).alias(n)
    return rounded(back.select(part("symbol"), part("timeframe"), *kinds))


@query("prediction_log_rounding", f"SELECT o_orderkey, o_orderstatus, {r('o_totalprice / 7', 'price', 4)}, {r('o_totalprice / 1e6', 'share', 4)} FROM orders")
def log_rounding(spark, sf):
    """Log rows in JSON, two batches, read back: every double has four digits."""
    path = _new(spark, "log")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 7).alias("price"), (F.col("o_totalprice") / 1e6).alias("share"))
    files.append_log(o.filter("o_orderkey % 2 = 0"), path)
    files.append_log(o.filter("o_orderkey % 2 <> 0"), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string, price double, share double").json(path)
