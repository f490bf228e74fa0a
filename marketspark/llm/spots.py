"""Document fingerprints from spot signatures, as DataFrame expressions only.

Anchors are common words of the corpus's languages; a signature is the chain of the next three content words (words that
are no anchors) after an anchor. The fingerprint is the sorted set of 32-bit signature hashes. Texts whose fingerprints can
reach a likeness have similar set sizes, so ``matches`` partitions sets by length and prunes by size before it compares.

Defined cases: words are runs of letters, lower-cased; a text without a full chain after an anchor uses the chains at every
content word, and a text with fewer than three content words one hash of itself; null counts as empty; equal texts have
equal fingerprints; the successor of a document is the next by (id, text hash), null ids first, after the last the first; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import shuffle_width

#: Common words that serve as anchors.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were "
    "what which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie "
    "sind so und von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se "
    "ses son sont sur un une vous "
    "al como con del donde el ella ellos era esta este fue ha hay la las lo los más mi muy no o para pero por porque su sus también "
    "una uno y ya").split()
CHAIN = 3
#: Segments of the id range with equal numbers of rows; each is divided evenly further on.
SEGMENTS = 256


def _chains(words: str, at) -> Column:
    """Hashes of the chains at the content words for which ``at`` holds."""
    w = F.col(words)
    found = F.transform(w, lambda x, i: F.when(at(x) & (i + CHAIN <= F.size(w)), F.xxhash64(*(F.get(w, i + k)["w"] for k in range(CHAIN))).bitwiseAND(0xFFFFFFFF)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def with_signatures(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``into``: the sorted set of signature hashes of the column ``text`` (nulls are empty)."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "))
    df = df.withColumn(f"{into}_w", F.split(plain, " "))
    w = F.col(f"{into}_w")
    tagged = F.transform(w, lambda x, i: F.struct(x.alias("w"), x.isin(*ANCHORS).alias("s"), (F.when(i > 0, F.get(w, i - 1).isin(*ANCHORS)).otherwise(False)).alias("a")))
    df = df.withColumn(f"{into}_c", F.filter(tagged, lambda x: ~x["s"]))
    df = df.withColumn(f"{into}_s", _chains(f"{into}_c", lambda x: x["a"]))
    every = F.when(F.size(f"{into}_s") > 0, F.col(f"{into}_s")).otherwise(_chains(f"{into}_c", lambda x: F.lit(True)))
    df = df.withColumn(f"{into}_s", every)
    alone = F.array(F.xxhash64(F.array_join(f"{into}_w", " ")).bitwiseAND(0xFFFFFFFF))
    return df.withColumn(into, F.when(F.size(f"{into}_s") > 0, F.col(f"{into}_s")).otherwise(alone)).drop(f"{into}_w", f"{into}_c", f"{into}_s")


def as_text(signatures: str) -> Column:
    """The fingerprint as a string: eight hexadecimal digits a signature, ascending."""
    return F.lower(F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; pairs whose sizes cannot reach ``least`` are not compared and give null."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    value = both / (F.size(a) + F.size(b) - both)
    return value if not least else F.when(small >= large * least, value)


def _ordered_buckets(df: DataFrame, key: str, width: int) -> tuple[DataFrame, Column]:
    """A bucket number for each row that ascends with ``key``: equal-depth segments, each divided evenly into parts."""
    inner = max(1, -(-2 * width // SEGMENTS))
    cuts = df.agg(F.percentile_approx(key, F.lit([i / SEGMENTS for i in range(SEGMENTS + 1)]), 5000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    edges = F.array(*(F.lit(c).cast("long") for c in cuts))
    k = F.size(F.filter(edges, lambda c: c <= F.col(key)))
    lo, hi = F.get(edges, k - 1), F.get(edges, k)
    part = F.coalesce(F.floor((F.col(key).cast("double") - lo.cast("double")) * inner / (hi.cast("double") - lo.cast("double"))), F.lit(0))
    return df, (k * inner + F.greatest(F.lit(0), F.least(F.lit(inner - 1), part))).cast("long")


def with_next(df: DataFrame, key: str, tie: str, payload: list[str]) -> DataFrame:
    """Adds ``next``: a struct of ``payload`` of the following row by (key, tie), after the last of the first.

    Rows are dealt by ranges of the key; the first row of each range also visits the range before as its last row, so no
    window spans the table. The driver sees one key for each range.
    """
    _, bucket = _ordered_buckets(df.select(key), key, shuffle_width(df.sparkSession))
    firsts = df.select(bucket.alias("b"), F.struct(key, tie).alias("k")).groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()
    before = {(r["k"][0], r["k"][1]): firsts[i - 1]["b"] for i, r in enumerate(firsts)}
    if not before:
        return df.withColumn("next", F.struct(*payload))
    spark = df.sparkSession
    ghosts = spark.createDataFrame([(k, t, b) for (k, t), b in before.items()], "__k long, __t long, __b long")  # one row a range
    rows = df.withColumn("__own", bucket).join(F.broadcast(ghosts), (F.col(key) == F.col("__k")) & (F.col(tie) == F.col("__t")), "left")
    rows = rows.withColumn("__place", F.explode(F.when(F.col("__b").isNull(), F.array(F.struct(F.col("__own").alias("b"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("__own").alias("b"), F.lit(False).alias("ghost")), F.struct(F.col("__b").alias("b"), F.lit(True).alias("ghost"))))))
    follow = Window.partitionBy("__place.b").orderBy("__place.ghost", key, tie)
    return rows.withColumn("next", F.lead(F.struct(*payload)).over(follow)).filter(~F.col("__place.ghost")).drop("__own", "__k", "__t", "__b", "__place")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, set_length, edited_sha256, both fingerprints, near_edited and near_next.

    The edited text is the text without its last half, followed by as many first characters of the next document.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), text.alias("text"), F.xxhash64(text).alias("tie"))
    docs = with_next(with_signatures(docs, "text", "own"), "key", "tie", ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)))
    docs = with_signatures(docs.withColumn("following", F.col("next.own")), "edited", "changed")
    return docs.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.size("own").alias("set_length"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))


def matches(queries: DataFrame, table: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, likeness) of all rows of ``table`` whose fingerprint is at least ``least`` like a query's.

    Sets are partitioned by length so that a query meets its own partition and the next ones on each side; inside, a pair
    needs a common signature among the first n - ceil(least n) + 1 of both, and sizes prune before sets are compared.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        own = with_signatures(df.select(F.col(id_col).alias(name), F.col(text_col).cast("string").alias("t")), "t", f"{name}_set").drop("t")
        n = F.size(f"{name}_set")
        band = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least))).cast("int")
        prefix = F.slice(f"{name}_set", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
        return own.select("*", band.alias(f"{name}_band"), prefix.alias(f"{name}_prefix"))

    q, t = sets(queries, "query_id"), sets(table, "match_id")
    q = q.withColumn("band", F.explode(F.array(F.col("query_id_band") - 1, F.col("query_id_band"), F.col("query_id_band") + 1))).withColumn("sig", F.explode("query_id_prefix"))
    t = t.withColumn("band", F.col("match_id_band")).withColumn("sig", F.explode("match_id_prefix"))
    pairs = q.join(t, ["band", "sig"]).filter(F.least(F.size("query_id_set"), F.size("match_id_set")) >= F.greatest(F.size("query_id_set"), F.size("match_id_set")) * least)
    # the pair counts where its first common signature lies, so that it comes out once
    first = F.array_min(F.array_intersect("query_id_prefix", "match_id_prefix"))
    return pairs.filter(first == F.col("sig")).withColumn("likeness", likeness("query_id_set", "match_id_set", least)).filter(F.col("likeness") >= least).select(
        "query_id", F.col("match_id").alias(id_col), "likeness")
