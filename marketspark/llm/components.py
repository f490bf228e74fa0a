"""Connected components of a link table by alternating stars, every step a Spark job over the links that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed


def _stars(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest of each node and its neighbours; partial minima make a hub with many links cheap."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("least"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its smallest node.

    Large star: every larger neighbour of a node is linked to the smallest node around it. Small star: the node and its
    smaller neighbours are. Both keep components as they are; a table of stars on the smallest node is the fixed point,
    reached in a number of rounds that grows with the logarithm of a component's size.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_stars(both), F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.filter("a <> b").distinct()
        near = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(near.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
        edges = checkpointed(small.filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
