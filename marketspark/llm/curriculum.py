"""Mixing sources to target weights with a time-varying curriculum, as DataFrame expressions only.

Every source has a share of all words, no more than ``most`` times its own (the excess goes to the others by weight), and a
schedule: its demand at time t of the run is target * (1 + slope * (2 t - 1)), so its integral over the run is the target.
A source's documents form a stream in the order of their id's md5, repeated as often as the target asks; the cumulative
demand is inverted at each document's place in the stream, which gives the time at which it is due. Range-sorting the
visits by that time gives the training order.

A source that holds a third of all rows is no single group: places are found from sums of 4,096 slices of a source.
The table of sources (one row each, three numbers) is ranked in one window.

Defined cases: null text has no words, a document without words is never taken; null is a source of its own, sorted last;
an empty table gives an empty plan; repeated rows are separate documents. The visit at which a source's demand ends stops
inside the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import shuffle_width, stored

WEIGHTS = (5, 2, 1)
#: Slope of the schedule of each weight class: the heavy sources fade, the light ones grow.
SLOPES = (-0.5, 0.0, 0.5)
MOST = 3
WORD_GAP = r"[\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(GAPS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_GAP))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST) -> DataFrame:
    """source, source_size, target, slope from (source, size): shares by weight, filled up to the caps from the smallest cap a weight."""
    scale = 1
    for w in weights:
        scale *= w
    index = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", (F.col("source_size") * most).alias("cap"), pick(weights).cast("long").alias("weight"),
        pick([float(x) for x in slopes]).alias("slope"))
    fill = Window.orderBy(F.col("cap") * F.lit(scale) / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    steps = ranked.select(
        "*", F.row_number().over(fill).alias("k"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    open_ = F.col("cap") * F.col("weight_left") > F.col("weight") * F.col("words_left")
    steps = steps.select("*", F.min(F.when(open_, F.struct("k", "words_left", "weight_left"))).over(everything).alias("level"))
    target = F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("level.words_left").cast("double") / F.col("level.weight_left").cast("double"))
    return steps.select("source", "source_size", target.alias("target"), "slope")


def due(share: Column, slope: Column) -> Column:
    """Time in [0, 1] at which a source has used ``share`` of its target: the inverse of t + slope (t^2 - t)."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise((root - (1 - slope)) / (2 * slope))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, slopes=SLOPES, most: int = MOST) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, text_hash, position (of its first visit, null if
    none) and ``visits``, an array of (visit, words, at)."""
    sizes = stored(df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")), "mix-sizes")
    targets = source_targets(sizes, weights, slopes, most)
    by = sizes.withColumn("slice", F.substring("key", 1, 3))
    in_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = by.groupBy("source", "slice").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("s2"), F.col("slice").alias("slice2"), F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("base"))
    in_slice = Window.partitionBy("source", "slice").orderBy("key", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = by.withColumn("inner", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    placed = placed.join(slices, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slice") == F.col("slice2")))
    targets = targets.select(F.col("source").alias("s3"), "source_size", "target", "slope")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("s3"))).select(
        "id", "source", "size", "source_size", "target", "slope", "text_hash", (F.col("base") + F.col("inner")).alias("begin"), quota.alias("quota"))
    visits = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda v: F.struct(
        v.alias("visit"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - v * F.col("source_size") - F.col("begin"))).cast("long").alias("words"),
        due(F.least(F.lit(1.0), (v * F.col("source_size") + F.col("begin")) / F.greatest(F.col("quota"), F.lit(1))), F.col("slope")).alias("at")))
    return placed.withColumn("visits", F.filter(visits, lambda v: v["words"] > 0)).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        F.aggregate("visits", F.lit(0).cast("long"), lambda a, v: a + v["words"]).alias("taken"), "text_hash",
        F.try_element_at(F.col("visits"), F.lit(1))["at"].alias("position"), "visits")


def by_due_time(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``plan`` range-sorted by the due time of their first visit; those never taken come last."""
    order = [F.col("position").asc_nulls_last(), F.col(id_col).asc_nulls_last()]
    return planned.repartitionByRange(shuffle_width(planned.sparkSession), *order).sortWithinPartitions(*order)


def training_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **schedule) -> DataFrame:
    """The mix itself: a row of ``df`` for every visit, range-sorted by due time. The one visit of a source that stops
    inside a document has its text cut after the words taken (joined by single spaces) and ``n_chars``, where there is
    such a column, set to match."""
    taken = plan(df, id_col, text_col, source_col, **schedule).filter("taken > 0").select(
        F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size"), F.explode("visits").alias("v"),
        F.col(source_col).alias("__source"))
    # rows that repeat exactly have one entry, and each of them gets its visits
    taken = taken.groupBy("__id", "__hash", "__source", "__size", "v.visit").agg(F.max("v").alias("__visit")).drop("visit")
    words = F.slice(F.split(F.btrim(F.col(f"`{text_col}`"), F.lit(GAPS)), WORD_GAP), F.lit(1), F.col("__visit.words").cast("int"))
    text = F.when(F.col("__visit.words") < F.col("__size"), F.array_join(words, " ")).otherwise(F.col(f"`{text_col}`"))
    keyed = df.withColumn("__h", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    full = keyed.join(taken, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")) & F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
    out = []
    for c in df.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("__visit.words") < F.col("__size"), F.length(text)).otherwise(F.col("n_chars")).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    width = shuffle_width(df.sparkSession)
    return full.select(*out, F.col("__visit.at").alias("__at")).repartitionByRange(width, "__at", id_col).sortWithinPartitions("__at", id_col).drop("__at")
