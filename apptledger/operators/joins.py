"""Joins from a large fact to a lookup that is unique on the key.

A lookup is broadcast only when its estimated size is below a limit. Above it
the join shuffles, and any key that holds more than a fair share of the rows is
spread over several partitions, with its single lookup row copied to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_CONF = "apptledger.broadcast.limitBytes"
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; unknown sizes come back as huge."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    limit = int(df.sparkSession.conf.get(BROADCAST_LIMIT_CONF, str(BROADCAST_LIMIT_BYTES)))
    return estimated_bytes(df) <= limit


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "inner",
    *,
    spread_by: list[str],
    bound: DataFrame | None = None,
    counted_in: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (one row per ``on``), keeping every match.

    ``spread_by`` names columns that tell the rows of one key apart.
    ``bound`` may name a table with at least as many rows as ``lookup``; its size
    is checked instead, for lookups computed by aggregation whose own estimate
    is meaningless. ``counted_in`` may name the rows ``facts`` was built from, so
    that looking for hot keys does not repeat the joins in between.
    """
    if fits_broadcast(lookup if bound is None else bound):
        return facts.join(F.broadcast(lookup), on, how)
    counts = rows_per_key(facts if counted_in is None else counted_in, [on])
    return spread_join(facts, lookup, [on], how, spread_by=spread_by, counts=counts)


def lookup_joins(facts: DataFrame, lookups: list[tuple[DataFrame, str, str]], spread_by: list[str]) -> DataFrame:
    """Several lookups in a row, each ``(lookup, on, how)``, with ``on`` a column of ``facts``."""
    rows = facts
    for lookup, on, how in lookups:
        rows = lookup_join(rows, lookup, on, how, spread_by=spread_by, counted_in=facts)
    return rows


def rows_per_key(rows: DataFrame, on: list[str]) -> DataFrame:
    """How many rows each known key has."""
    return rows.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    spread_by: list[str],
    counts: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Shuffle join that splits keys holding more than a partition's share.

    At most one key per partition can exceed that share, so the list of hot keys
    has a fixed bound and their copies add up to at most twice the partitions.
    The split hashes ``spread_by``, so a task that is run again sends each row to
    the same place. ``counts`` may hand in the rows per key (``*on, _rows``) when
    they are computed anyway, or another measure of its work. ``partitions`` sets how
    many there are, whatever their size: few rows can make many.
    """
    slots = partitions or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = rows_per_key(facts, on)
    share = counts.agg((F.sum("_rows") / F.lit(slots)).alias("share")).scalar()
    hot = (
        counts.where(F.col("_rows") > share)
        .select(*on, F.least(F.ceil(F.col("_rows") / share), F.lit(slots)).cast("int").alias("_copies"))
    )

    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()
    token = F.xxhash64(*spread_by)
    salted = facts.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.when(~known, F.pmod(token, F.lit(slots)).cast("int"))
        .when(F.col("_copies").isNotNull(), F.pmod(token, F.col("_copies")).cast("int"))
        .otherwise(F.lit(0)),
    ).drop("_copies")
    copied = lookup.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
    ).drop("_copies")
    if partitions:
        salted, copied = (side.repartition(slots, *on, "_salt") for side in (salted, copied))
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")
