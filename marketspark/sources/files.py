"""Readers and writers for the file families of a market-data directory."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import PIECE_ROWS, guarded, hashed_normal, hashed_uniform, running
from ..session import ship

c = F.col

#: Columns and Spark types per family.
KLINES = {
    "timestamp": "long", "open_time": "long", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double",
    "quote_volume": "double", "trades": "long", "taker_buy_volume": "double", "taker_buy_quote_volume": "double",
}
FAMILIES: Mapping[str, Mapping[str, str]] = {
    "klines": KLINES,
    "funding_rate": {"funding_time": "long", "timestamp": "long", "funding_rate": "double", "mark_price": "double"},
    "open_interest": {"timestamp": "long", "sum_open_interest": "double", "sum_open_interest_value": "double"},
    "long_short_ratio": {"timestamp": "long", "long_short_ratio": "double", "long_account": "double", "short_account": "double"},
    "taker_volume": {"timestamp": "long", "buy_sell_ratio": "double", "buy_vol": "double", "sell_vol": "double"},
    "mark_price": {"timestamp": "long", "open": "double", "high": "double", "low": "double", "close": "double"},
    "premium_index": {"timestamp": "long", "open": "double", "high": "double", "low": "double", "close": "double"},
}
PREFIX = {"mark_price": "mark", "premium_index": "premium"}
TIME_COLUMNS = ("funding_time", "timestamp", "open_time")
#: Family name in a file name, then market, symbol and an optional timeframe.
NAME = r"^(klines|funding_rate|open_interest|long_short_ratio|taker_volume|mark_price|premium_index)_usdt_m_([A-Z0-9]+?)(?:_([0-9]+[mhdw]))?\.csv$"

#: The same inside a path, where the named file may be a folder of parts.
IN_PATH = NAME.replace("^", "(?:^|/)").replace("$", "(?:/|$)")

NAMED_PART = "/([^/]+[.]csv)(?:/[^/]*)?$"

TICKS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType()),
    T.StructField("base_qty", T.DoubleType()), T.StructField("time", T.LongType()), T.StructField("is_buyer_maker", T.BooleanType()),
])


#: Bytes of a file that may hold its header.
HEADER_BYTES = 1 << 16
#: Files that a task opens at a time for their headers.
THREADS = 16
#: Schemes that tasks open themselves, by the name that their library has for them.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def header_line(path: str) -> str:
    """The first line of one file; a bounded beginning of it is read, from the task that asks."""
    from pyarrow import fs

    scheme, rest = re.match(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(.*)", path, re.S).groups("")
    if SCHEMES[scheme] == "file":
        store, inside = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        store, inside = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    with store.open_input_stream(inside) as f:
        return (f.read(HEADER_BYTES).decode("utf-8", "replace").splitlines() or [""])[0]


def _first_line(fs, path) -> str:
    jvm = SparkSession.active()._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(path), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def headers_of(paths: DataFrame) -> DataFrame:
    """(path, header) of the files of ``paths`` (column path): one line of each, read where the tasks run.

    Only files of a store that just the JVM can open are read through the driver.
    """
    spark = paths.sparkSession
    ship(spark)
    near = F.regexp_extract("path", "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1).isin(*SCHEMES)
    every, distant = paths.agg(F.count(F.lit(1)), F.count_if(~near)).first()
    width = max(1, min(-(-every // THREADS), int(spark.conf.get("spark.sql.shuffle.partitions"))))  # few files are few tasks

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            with ThreadPoolExecutor(THREADS) as pool:
                yield pd.DataFrame({"path": p["path"], "header": list(pool.map(header_line, p["path"]))})

    found = paths.filter(near).select("path").repartition(width).mapInPandas(read, "path string, header string")
    if distant:
        far = [r["path"] for r in paths.filter(~near).collect()]
        conf, root = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        lines = [(p, _first_line(root(p).getFileSystem(conf), root(p))) for p in far]
        found = found.unionByName(spark.createDataFrame(lines, "path string, header string"))
    return found


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files that match a pattern and hold something; a folder with a matching name is a file written in parts."""
    return spark.read.format("binaryFile").load(pattern).filter("length > 0").select("path")


def header_groups(paths: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Files by their header. The names come to the driver, as in any listing; their contents do not."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in headers_of(paths).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).toLocalIterator():
        names = tuple(x.strip().lstrip("\ufeff") for x in next(csv.reader([r["header"]]), []))
        groups.setdefault(names, []).extend(r["paths"])
    return groups


def read_by_header(spark: SparkSession, pattern: str, kinds: Mapping[str, str]) -> DataFrame | None:
    """``path`` and the columns of ``kinds`` by name, from files whose headers may differ; None if there is no file."""
    try:
        return read_groups(spark, header_groups(listed(spark, pattern)), kinds)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_groups(spark: SparkSession, groups: Mapping[tuple[str, ...], list[str]], kinds: Mapping[str, str]) -> DataFrame | None:
    """Files with the same header are one CSV scan, so no row is ever joined to its header. Quoted, signed and space-led cells
    are the reader's business; a column that a file lacks, and a cell that is no number, are null.
    """
    parts = []
    for names, paths in sorted(groups.items()):
        fields = [f"_{i}" for i in range(len(names))]
        rows = spark.read.schema(", ".join(f"{f} string" for f in fields)).csv(
            paths, header=True, enforceSchema=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        place = {n: f for f, n in reversed(list(zip(fields, names)))}
        parts.append(rows.select(c("_metadata.file_path").alias("path"), *[
            (c(place[n]) if n in place else F.lit(None).cast("string")).try_cast(k).alias(n) for n, k in kinds.items()]))
    return reduce(DataFrame.unionByName, parts) if parts else None


def narrowed(kinds: Mapping[str, str]) -> dict[str, str]:
    """Half-width types, but for times and the two volumes that outgrow them."""
    wide = (*TIME_COLUMNS, "volume", "quote_volume")
    return {n: k if n in wide else {"double": "float", "long": "int"}[k] for n, k in kinds.items()}


def scan_family(spark: SparkSession, base: str, family: str, narrow: bool = False, symbol: str = "*", timeframe: str = "*") -> DataFrame:
    """One family over all or some symbols (and timeframes): typed, in UTC, metadata columns dropped.

    Symbol and timeframe are parts of the file name, so other files are not opened.
    """
    cols = narrowed(FAMILIES[family]) if narrow else dict(FAMILIES[family])
    df = read_by_header(spark, f"{base}/{family}_usdt_m_{symbol}{f'_{timeframe}' if family == 'klines' else ''}.csv", cols)
    if df is None:
        df = spark.createDataFrame([], ", ".join(["path string", *(f"{n} {k}" for n, k in cols.items())]))
    times = [n for n in TIME_COLUMNS if n in cols]
    prefix = PREFIX.get(family)
    values = [c(n).alias(f"{prefix}_{n}") if prefix else c(n) for n in cols if n not in times]
    keys = {"symbol": 2, "timeframe": 3} if family == "klines" else {"symbol": 2}
    df = df.select(*[F.regexp_extract("path", IN_PATH, i).alias(n) for n, i in keys.items()], F.timestamp_millis(F.coalesce(*times)).alias("ts"), *values)
    df = df.filter("ts is not null")
    return df.withColumn("buy_ratio", guarded("taker_buy_volume", "volume")) if family == "klines" else df


def scan_klines(spark: SparkSession, base: str, symbol: str | None = None, timeframe: str | None = None, narrow: bool = False) -> DataFrame:
    """Bars of all or one symbol and timeframe."""
    return scan_family(spark, base, "klines", narrow, symbol or "*", timeframe or "*")


def optional_families(spark: SparkSession, base: str, families: Sequence[str] = tuple(f for f in FAMILIES if f != "klines")) -> dict[str, DataFrame]:
    """The side inputs that exist in the directory, by family."""
    have = {r["family"] for r in inventory(spark, base).select("family").collect()}  # at most seven names
    return {f: scan_family(spark, base, f) for f in families if f in have}


def discover(spark: SparkSession, base: str) -> DataFrame:
    """Distinct (family, symbol, timeframe) from file names."""
    f = files(spark, base)
    return f.select("family", "symbol", "timeframe").distinct()


def files(spark: SparkSession, base: str) -> DataFrame:
    """Name, size and parsed parts of every file; contents are not read. The parts of a folder with a file's name are one file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    f = f.withColumn("file", F.coalesce(F.nullif(F.regexp_extract("path", NAMED_PART, 1), F.lit("")), F.regexp_extract("path", "([^/]+)$", 1)))
    f = f.groupBy("file").agg(F.sum("length").alias("length"))
    return f.select("file", "length", *[F.regexp_extract("file", NAME, i).alias(n) for i, n in ((1, "family"), (2, "symbol"), (3, "timeframe"))])


def inventory(spark: SparkSession, base: str) -> DataFrame:
    return files(spark, base).filter("family <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def data_version(names: DataFrame, column: str = "file", chars: int = 12) -> DataFrame:
    """Number of files and a version that changes with their names, whatever their order.

    The names' md5 halves are added up, so no list of names is gathered; the published form hashes the sorted list.
    """
    half = lambda at: F.sum(F.conv(F.substring(F.md5(column), at, 15), 16, 10).cast("decimal(38,0)"))
    g = names.agg(F.count(F.lit(1)).alias("files"), half(1).alias("a"), half(17).alias("b"))
    return g.select("files", F.substring(F.md5(F.concat_ws(",", c("files").cast("string"), c("a").cast("string"), c("b").cast("string"))), 1, chars).alias("version"))


# ---------------------------------------------------------------- ticks


def tick_symbol(path: str) -> Column:
    """Symbol of a tick file: the start of its name up to the first underscore; the named file may be a folder of parts.

    Every row asks for it, so the path is cut at its slashes; a pattern would be tried at each of its characters.
    """
    parts = [F.ltrim(F.substring_index(F.substring_index(path, "/", -2), "/", 1), F.lit("_")), F.ltrim(F.substring_index(path, "/", -1), F.lit("_"))]
    return F.coalesce(*[F.when(x.endswith(".csv") & x.contains("_"), F.substring_index(x, "_", 1)) for x in parts], F.lit(""))


def scan_ticks(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Tick files of a pattern, columns bound by name; the symbol is the file name up to the first underscore.

    A stream takes the columns in the order of ``TICKS`` and fails on a file whose header has another; ``land_ticks`` is the
    form for headers that differ.
    """
    if streaming:
        reader = spark.readStream.schema(TICKS).options(header="true", enforceSchema="false", recursiveFileLookup="true")
        df = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).csv(path)
        return _typed_ticks(df.select(c("_metadata.file_path").alias("path"), *TICKS.names))
    df = read_by_header(spark, path, TICK_KINDS)
    return _typed_ticks(spark.createDataFrame([], "path string, " + ", ".join(f"{n} {k}" for n, k in TICK_KINDS.items())) if df is None else df)


TICK_KINDS = {f.name: f.dataType.simpleString() for f in TICKS}


def _typed_ticks(df: DataFrame) -> DataFrame:
    return df.select(tick_symbol("path").alias("symbol"), "id", "price", "qty", "base_qty", F.timestamp_millis("time").alias("ts"), "is_buyer_maker")


def land_ticks(spark: SparkSession, path: str, landed: str, checkpoint: str, files_per_trigger: int = 10_000, trigger: dict | None = None):
    """Streams arriving tick files of any header into the Parquet table ``landed``, which is a stream source in turn.

    A batch is a set of new file names. Its headers are read by tasks, kept as a registry (header, files) beside the table,
    and each header's files are one scan by name. A batch overwrites its own folders, so one that runs again changes nothing.
    """
    listing = "path string, modificationTime timestamp, length long, content binary"  # fixed columns of the format; only the first is read
    names = spark.readStream.format("binaryFile").schema(listing).options(recursiveFileLookup="true", maxFilesPerTrigger=files_per_trigger).load(path).filter("length > 0").select("path")

    def run(batch: DataFrame, batch_id: int) -> None:
        groups = header_groups(batch)  # no more files than one trigger takes
        if groups:
            known = batch.sparkSession.createDataFrame([(",".join(n), len(p)) for n, p in groups.items()], "header string, files long")
            known.write.mode("overwrite").json(f"{landed}-headers/batch={batch_id}")
            _typed_ticks(read_groups(batch.sparkSession, groups, TICK_KINDS)).write.mode("overwrite").parquet(f"{landed}/batch={batch_id}")

    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_by_id(ticks: DataFrame, keys: Sequence[str] = ("symbol", "id"), order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per trade id, the earliest; combines before the shuffle."""
    rest = [x for x in ticks.columns if x not in keys]
    best = ticks.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *[x for x in rest if x not in order])).alias("r"))
    return best.select(*keys, *[c(f"r.{x}").alias(x) for x in rest]).select(*ticks.columns)


def stitch_pages(pages: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "ts"), order: str = "page") -> DataFrame:
    """Union of history pages: the first page wins for a repeated time."""
    return first_by_id(pages, keys, (order,)).drop(order)


# ---------------------------------------------------------------- raw payloads


def parse_klines(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON arrays of bars (8 or 12 cells, numbers or strings) to typed rows; unreadable prices drop the row."""
    cells = F.explode(F.from_json(column, "array<array<string>>")).alias("k")
    k = payloads.select(*[x for x in payloads.columns if x != column], cells)
    num = lambda i: F.get("k", F.lit(i)).try_cast("double")
    long_form = F.size("k") >= 12
    out = k.select(
        *[x for x in k.columns if x != "k"], F.timestamp_millis(F.get("k", F.lit(0)).try_cast("long")).alias("ts"),
        *[num(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], num(7).alias("quote_volume"),
        F.when(long_form, F.get("k", F.lit(8)).try_cast("long")).alias("trades"), F.when(long_form, num(9)).alias("taker_buy_volume"),
        F.when(long_form, num(10)).alias("taker_buy_quote_volume"))
    return out.dropna(subset=["open", "high", "low", "close", "volume"])


#: Payload field names per derivative family.
PAYLOADS = {
    "funding": ("fundingTime", {"fundingRate": "funding_rate"}),
    "open_interest": ("timestamp", {"sumOpenInterest": "sum_open_interest", "sumOpenInterestValue": "sum_open_interest_value"}),
    "long_short": ("timestamp", {"longShortRatio": "long_short_ratio", "longAccount": "long_account", "shortAccount": "short_account"}),
}


def parse_derivatives(payloads: DataFrame, family: str, column: str = "payload") -> DataFrame:
    """JSON arrays of objects with string numbers to typed rows."""
    time, fields = PAYLOADS[family]
    schema = f"array<struct<{time}:string," + ",".join(f"{f}:string" for f in fields) + ">>"
    e = payloads.select(*[x for x in payloads.columns if x != column], F.explode(F.from_json(column, schema)).alias("e"))
    return e.select(*[x for x in e.columns if x != "e"], F.timestamp_millis(c(f"e.{time}").try_cast("long")).alias("ts"),
                    *[c(f"e.{f}").try_cast("double").alias(n) for f, n in fields.items()])


def relaxed_union(frames: Sequence[DataFrame], keep_text: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Union of frames with drifting columns; every number becomes double."""
    numbers = {"int", "bigint", "smallint", "tinyint", "float", "double", "string"}

    def relax(df: DataFrame) -> DataFrame:
        return df.select(*[c(n).try_cast("double").alias(n) if t in numbers and n not in keep_text else c(n) for n, t in df.dtypes])

    out = relax(frames[0])
    for f in frames[1:]:
        out = out.unionByName(relax(f), allowMissingColumns=True)
    return out


def feature_table(spark: SparkSession, base: str, bars: DataFrame | None = None) -> DataFrame:
    """A stored feature table: Parquet if there is one, else CSV, else the base set from bars."""
    from pyspark.errors import AnalysisException

    from ..operators.features.technical import base_features

    for reader in (lambda: spark.read.parquet(f"{base}/*features*.parquet"), lambda: spark.read.csv(f"{base}/*features*.csv", header=True, inferSchema=True)):
        try:
            return reader()
        except AnalysisException:
            continue
    if bars is None:
        raise FileNotFoundError(f"no feature table under {base}")
    return base_features(bars)


# ---------------------------------------------------------------- sinks


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per symbol and timeframe; a hot symbol is split over several files."""
    keyed = bars.withColumn("_slice", F.floor(F.unix_seconds("ts") / (365 * 86_400)))
    out = keyed.repartition("symbol", "timeframe", "_slice").drop("_slice").sortWithinPartitions("symbol", "timeframe", "ts")
    out.write.mode("overwrite").partitionBy("timeframe", "symbol").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_snapshot(bars: DataFrame, path: str, date: str) -> None:
    bars.withColumn("snapshot_date", F.lit(date)).write.mode("append").partitionBy("symbol", "interval", "snapshot_date").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each series' latest snapshot; partition values only decide which files are read."""
    df = spark.read.parquet(path)
    latest = df.groupBy("symbol", "interval").agg(F.max("snapshot_date").alias("snapshot_date"))
    return df.join(latest, ["symbol", "interval", "snapshot_date"], "left_semi").drop("snapshot_date")


def append_log(df: DataFrame, path: str, digits: int = 4) -> None:
    """One JSON object per row, doubles rounded."""
    log_rows(df, digits).write.mode("append").json(path)


def log_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(c(n), digits) for n, t in df.dtypes if t in ("double", "float")})


def log_lines(df: DataFrame, digits: int = 4, level: str = "INFO", logger: str = "engine") -> DataFrame:
    """Structured log rows ``(level, logger, message)`` with the row as JSON."""
    return log_rows(df, digits).select(F.lit(level).alias("level"), F.lit(logger).alias("logger"), F.to_json(F.struct(*df.columns)).alias("message"))


# ---------------------------------------------------------------- synthetic


def synthetic_bars(spark: SparkSession, bars: int = 10_000, symbols: Sequence[str] = ("BTCUSDT", "ETHUSDT", "SOLUSDT"),
                   timeframes: Sequence[str] = ("5m", "15m", "1h", "4h", "1d"), seed: int = 42, sigma: float = 0.02) -> DataFrame:
    """Lognormal walks with noisy ranges and exponential volume."""
    from ..operators.bars import TIMEFRAMES

    step = F.create_map(*[x for t in timeframes for x in (F.lit(t), F.lit(TIMEFRAMES[t]))])
    normal = lambda k: hashed_normal(k, "symbol", "timeframe", "id")
    g = spark.range(bars).withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols]))).withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    g = g.withColumns({
        "_z": normal(seed) * sigma, "_a": F.abs(normal(seed + 1)) * 0.005, "_b": F.abs(normal(seed + 2)) * 0.005,
        "_o": normal(seed + 3) * 0.002, "_v": hashed_uniform(seed + 4, "symbol", "timeframe", "id")})
    g = running(g, ["symbol", "timeframe"], ["id"], F.floor(c("id") / PIECE_ROWS), {"_w": ("sum", c("_z"))})
    close = 100 * F.exp("_w")
    g = g.withColumns({"close": close, "open": close * (1 + c("_o"))})
    return g.select("symbol", "timeframe", F.timestamp_seconds(F.lit(1_704_067_200) + c("id") * F.element_at(step, c("timeframe"))).alias("ts"), "open",
                    (F.greatest("open", "close") * (1 + c("_a"))).alias("high"), (F.least("open", "close") * (1 - c("_b"))).alias("low"), "close", (-F.log(1 - c("_v")) * 1000).alias("volume"),
                    c("id").alias("pos"), F.lit(bars).cast("long").alias("n"))


def fat_tailed_returns(spark: SparkSession, rows: int = 5_000, seed: int = 42, sigma: float = 0.02, share: float = 0.01, factor: float = 3.0) -> DataFrame:
    """Normal returns of which a share is scaled up."""
    r = hashed_normal(seed, "id") * sigma
    return spark.range(rows).select(c("id").alias("pos"), F.when(hashed_uniform(seed + 1, "id") < share, r * factor).otherwise(r).alias("r"))

