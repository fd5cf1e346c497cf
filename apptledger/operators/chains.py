"""Following links from row to row to where they end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.operators.joins import lookup_join
from apptledger.session import materialized


def followed(links: DataFrame) -> DataFrame:
    """For each ``node`` of links (node, up), where its links end and how many there are.

    Every round doubles how far each row has looked, so links of length n take
    log2(n) rounds. Rows that arrive are written once, to the shared folder, and
    only the others go on. Of the rows still open the ones nearest to their end
    arrive in each round; a round in which none does leaves cycles only, and the
    rows in or before a cycle get a NULL ``root`` and NULL ``hops``.
    """
    links = materialized(links.select("node", "up", F.lit(1).cast("bigint").alias("hops")), "chain-links")
    further = links.select(F.col("node").alias("up"), F.lit(1).alias("_more"))
    first = materialized(lookup_join(links, further, "up", "left", spread_by=["node"]), "chain")
    arrived = [first.where(F.col("_more").isNull()).select("node", "up", "hops")]
    waiting = first.where(F.col("_more").isNotNull()).select("node", "up", "hops")

    while not waiting.isEmpty():
        ends = reduce(DataFrame.unionByName, arrived).withColumn("_done", F.lit(True))
        parents = ends.unionByName(waiting.withColumn("_done", F.lit(False))).select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), "_done"
        )
        moved = materialized(lookup_join(waiting, parents, "up", spread_by=["node"]).select(
            "node", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), "_done"
        ), "chain")
        now = moved.where("_done").drop("_done")
        if now.isEmpty():
            break
        arrived.append(now)
        waiting = moved.where("not _done").drop("_done")

    lost = waiting.select("node", F.lit(None).cast(links.schema["up"].dataType).alias("up"), F.lit(None).cast("bigint").alias("hops"))
    return reduce(DataFrame.unionByName, [*arrived, lost]).withColumnRenamed("up", "root")
