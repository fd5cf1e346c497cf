"""Consecutive ids without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows are ranked inside buckets taken from the first hex digits of the key's
# MD5, and each bucket starts where the ones before it end. Buckets stay even
# whatever the keys look like, and the table of starts never exceeds 16^digits.
BUCKET_DIGITS = 3


def assign_ids(df: DataFrame, key: str, id_column: str, start: Column | int = 0) -> DataFrame:
    """Add ``start + 1, start + 2, ...`` in (bucket, key) order.

    ``key`` must be unique. The order is a function of the keys alone, so a task
    that is run again gives every row the same id.
    """
    start = F.lit(start) if isinstance(start, int) else start
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, BUCKET_DIGITS))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rank", rank)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(id_column, (F.coalesce(start, F.lit(0)) + F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_bucket", "_rank", "_start")
    )
