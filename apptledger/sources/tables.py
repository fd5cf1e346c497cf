"""Domain tables as Parquet."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.model import LINES, SCHEMAS, Tables, conform
from apptledger.operators.billing import lines_from_json
from apptledger.operators.changes import insert_or_ignore
from apptledger.session import materialized
from apptledger.settings import seed_settings

# Stored layout: facts are split by the date the views filter on.
PARTITION_DATE = {"appointments": ("appointment_date", "scheduled_start")}
# Tables whose own date column splits them.
SPLIT_BY = {"mileage": "trip_date", "invoices": "invoice_date"}


def load_tables(spark: SparkSession, base: str) -> Tables:
    """Read the tables with their declared schemas, no inference.

    The stored ``appointment_date`` stays on the appointments so that date
    filters prune partitions. A snapshot from before invoice lines were rows gives those its invoices' JSON holds.
    """
    def opened(name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if name in PARTITION_DATE:
            schema = T.StructType([*schema.fields]).add(PARTITION_DATE[name][0], "date")
        try:
            rows = spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{name}")
            return rows.select(*schema.fieldNames()) if name in SPLIT_BY else rows
        except AnalysisException as error:
            if name != LINES or error.getCondition() != "PATH_NOT_FOUND":
                raise
            return lines_from_json(opened("invoices"))

    return Tables(**{name: partial(opened, name) for name in Tables.names()})


def save(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet, optionally partitioned.

    The rebalance hint gathers rows by the partition column and lets the runtime
    split a day that is much larger than the rest.
    """
    if by is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def save_tables(tables: Tables, base: str) -> None:
    """Write a snapshot to a new folder; a path being read is never overwritten."""
    for name in Tables.names():
        df = conform(getattr(tables, name), name)
        path = f"{base.rstrip('/')}/{name}"
        if name in PARTITION_DATE:
            date_column, source = PARTITION_DATE[name]
            save(df.withColumn(date_column, F.to_date(source)), path, by=date_column)
        elif name in SPLIT_BY:
            save(df, path, by=SPLIT_BY[name])
        else:
            save(df, path)


def days_of(tables: Tables, ids: DataFrame) -> list[dt.date]:
    """The stored days that hold the given appointments: calendar dates, so a
    short list however many appointments there are."""
    wanted = ids.select("appointment_id").distinct()
    days = tables.appointments.select("appointment_id", "appointment_date").join(
        wanted, "appointment_id", "left_semi"
    ).select("appointment_date").distinct()
    return sorted(row.appointment_date for row in days.collect())


def within_days(tables: Tables, days: list[dt.date]) -> Tables:
    """The tables with only these days of appointments, for a change that touches
    no others. The dates prune partitions, so the rest is not read, except for the
    highest id and for the holders of a place, which rules take from all rows."""
    whole = tables.appointments
    part = whole.where(F.col("appointment_date").isin(days))
    return Tables(whole=lambda: whole, **{**{n: getattr(tables, n) for n in Tables.names()}, "appointments": part})


def replace_days(appointments: DataFrame, days: list[dt.date], base: str) -> None:
    """Write the changed rows of ``days`` over those partitions and leave the rest.

    ``appointments`` holds all rows of those days. Rows are first written to the
    shared folder, so the folder being replaced is not read at the same time and
    a failed replacement can be repeated from the copy. A row that moved to a day
    outside ``days`` would replace that day's rows, so it is refused.
    """
    date_column, source = PARTITION_DATE["appointments"]
    rows = conform(appointments, "appointments").withColumn(date_column, F.to_date(source))
    copy = materialized(rows, "changed-days")
    if not copy.where(~F.col(date_column).isin(days)).isEmpty():
        raise ValueError("rows moved to days that were not read; add those days first")
    (
        copy.hint("rebalance", date_column).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(date_column)
        .parquet(f"{base.rstrip('/')}/appointments")
    )


def with_seed_settings(settings: DataFrame) -> DataFrame:
    """Add the seed rows that are missing, leaving existing values alone."""
    return insert_or_ignore(settings, seed_settings(settings.sparkSession), ["key"])
