"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.session import materialized


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the least node that can be reached.

    Each round ties the neighbours of a node to the least of them, the greater ones first and then the
    smaller ones, and stores the links. Stars are a fixed point, reached after about the logarithm of
    a component's size. Minima are combined before any shuffle, so a node with very many links costs
    its task one row per input task; the join that follows is one that Spark splits at large keys.
    """
    edges = materialized(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
        edges = materialized(small.where("a <> b").distinct(), "links")
        # Two numbers tell whether a round changed anything.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
