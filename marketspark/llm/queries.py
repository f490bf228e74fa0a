"""Registered queries of the corpus operators, one for each, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstoken, curriculum, exact, language, ngram_join, packing, periods, quality, sharding, spots, substrings, suffixes, toxicity
from .tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf_dir))


@query("op7_mix_sources", """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS c
  FROM d GROUP BY 1),
r AS (SELECT *, 3 * source_size AS cap, CASE c WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (
  SELECT *, row_number() OVER o AS k,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM r WINDOW o AS (ORDER BY cap * (10 // w), source NULLS LAST)),
l AS (SELECT k AS lk, CAST(words_left AS DOUBLE) AS lw, CAST(w_left AS DOUBLE) AS lv FROM f WHERE cap * w_left > w * words_left
      ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN lk IS NULL OR k < lk THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * lw / lv END AS target
  FROM f LEFT JOIN l ON true),
p AS (
  SELECT doc_id, d.size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS q,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform(range(0, 4),
         lambda v: greatest(0, least(size, q - v * source_size - b)))) AS BIGINT) AS taken
FROM p""")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.by_due_time(curriculum.plan(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@query("op9_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir))


@query("op3_super_kmer_dedup")
def super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.strip(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.strip(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_curve_packing")
def curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op5_spot_fingerprints")
def spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprints(documents(spark, sf_dir))


@query("op2_language_ftrl")
def language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query("op6_quality_nbsvm")
def quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op11_counterfactual_toxicity")
def counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_crosstoken_alignment")
def crosstoken_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periods.collapse(docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
