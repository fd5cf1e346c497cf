"""Streaming DataFrame in, streaming DataFrame out.

Event times are TIMESTAMP columns; watermarks reject local times.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptledger.functions.times import local_time, offset_in_seconds
from apptledger.model import Tables
from apptledger.operators.changes import apply_changes, latest_per_key
from apptledger.operators.completion import KEPT_WHEN_ABSENT, completion_changes, matched_records
from apptledger.operators.usage import PRICES, metered_cost
from apptledger.session import materialized, scratch_path
from apptledger.streaming.keyed import first_within, keyed_state


def once_per_key(rows: DataFrame, key: str, event_time: str, delay: str, slots: int | None = None) -> DataFrame:
    """First row of each key within the watermark.

    Copies are first reduced within ``slots`` groups of input partitions, so a key
    with very many copies is spread over that many tasks; the second step then
    sees at most ``slots`` rows of it per batch and makes the result exact. There
    are as many groups as shuffle partitions unless told otherwise.
    """
    slots = slots or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slotted = rows.withWatermark(event_time, delay).withColumn("_slot", F.spark_partition_id() % slots)
    return (
        slotted.dropDuplicatesWithinWatermark([key, "_slot"]).drop("_slot").dropDuplicatesWithinWatermark([key])
    )


def submissions_once(
    submissions: DataFrame, event_time: str = "submitted_at", delay: str = "1 hour", slots: int | None = None
) -> DataFrame:
    """Each completion record once, however often the feed repeats it."""
    return once_per_key(submissions, "submission_id", event_time, delay, slots)


def commands_once(
    commands: DataFrame, event_time: str = "issued_at", ttl: str = "24 hours", delay: str = "24 hours"
) -> DataFrame:
    """Outbound commands with retries removed: of one idempotency key the first, and again the first that comes ``ttl`` or
    more after the one accepted last. Commands pass as they arrive; ``delay`` only says how late one may be.
    Start the query inside ``keyed_state``."""
    number, unit = ttl.split()
    return first_within(commands, "idempotency_key", event_time, int(number) * UNIT_SECONDS[unit.rstrip("s")], delay)


UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def local_window(event_time: str, width: str, offset: str) -> Column:
    """Tumbling windows counted from the business's local midnight; ``width`` such
    as ``1 hour``."""
    number, unit = width.split()
    start = -offset_in_seconds(offset) % (int(number) * UNIT_SECONDS[unit.rstrip("s")])
    return F.window(event_time, width, startTime=f"{start} seconds")


def shift_stamps(
    punches: DataFrame, event_time: str = "ts", delay: str = "2 hours", offset: str = "+00:00", quiet: str = "1 day"
) -> DataFrame:
    """First check-in and last check-out per shift, on the local day it began.

    A session per shift rather than a join of ins with outs: it keeps one small
    state row per shift however many punches a shift gets, goes on over midnight,
    and emits a shift when it has been ``quiet`` for so long, with or without a
    check-out.
    """
    time = F.col(event_time)
    return (
        punches.withWatermark(event_time, delay)
        .groupBy(F.session_window(event_time, quiet).alias("stay"), "shift_id", "worker_id")
        .agg(
            F.min(F.when(F.col("type") == "in", time)).alias("actual_in"),
            F.max(F.when(F.col("type") == "out", time)).alias("actual_out"),
            F.count(F.lit(1)).alias("punch_count"),
        )
        .select(
            local_time(F.col("stay.start"), offset).cast("date").alias("work_date"),
            "shift_id", "worker_id", "actual_in", "actual_out", "punch_count",
        )
    )


def time_on_site(
    punches: DataFrame, event_time: str = "ts", delay: str = "2 hours", offset: str = "+00:00", quiet: str = "1 day"
) -> DataFrame:
    """Shifts that were checked in and out, with the seconds between."""
    stamps = shift_stamps(punches, event_time, delay, offset, quiet)
    return stamps.where(F.col("actual_out") >= F.col("actual_in")).withColumn(
        "seconds_on_site", F.unix_seconds("actual_out") - F.unix_seconds("actual_in")
    )


def missing_checkout(
    punches: DataFrame, event_time: str = "ts", delay: str = "2 hours", offset: str = "+00:00", quiet: str = "1 day"
) -> DataFrame:
    """Shifts checked in that stayed quiet without a later check-out. ``quiet``, longer than any
    shift, and ``delay`` add up to how late the alert comes."""
    stamps = shift_stamps(punches, event_time, delay, offset, quiet)
    left = F.coalesce(F.col("actual_out") >= F.col("actual_in"), F.lit(False))
    return stamps.where(F.col("actual_in").isNotNull() & ~left).select(
        "work_date", "shift_id", "worker_id", "actual_in"
    )


def missing_checkin(
    feed: DataFrame, event_time: str = "ts", delay: str = "2 hours", offset: str = "+00:00", quiet: str = "1 day"
) -> DataFrame:
    """Shifts scheduled that stayed quiet without a check-in.

    ``feed`` holds punches and, with type ``scheduled``, one row per planned shift
    at its start.
    """
    time = F.col(event_time)
    return (
        feed.withWatermark(event_time, delay)
        .groupBy(F.session_window(event_time, quiet).alias("stay"), "shift_id", "worker_id")
        .agg(
            F.min(F.when(F.col("type") == "scheduled", time)).alias("scheduled_at"),
            F.sum((F.col("type") == "in").cast("int")).alias("check_ins"),
        )
        .where(F.col("scheduled_at").isNotNull() & (F.col("check_ins") == 0))
        .select(local_time(F.col("stay.start"), offset).cast("date").alias("work_date"), "shift_id", "worker_id", "scheduled_at")
    )


def daily_counts(
    punches: DataFrame, event_time: str = "ts", delay: str = "2 hours", width: str = "1 day", offset: str = "+00:00"
) -> DataFrame:
    """Punches per local window and type and what they cost."""
    return (
        punches.withWatermark(event_time, delay)
        .groupBy(local_window(event_time, width, offset).alias("w"), "type")
        .agg(
            F.count(F.lit(1)).alias("punches"),
            F.sum(F.col("gps_verified").cast("int")).alias("verified"),
            (F.count(F.lit(1)) * F.lit(PRICES["punch"])).alias("cost"),
        )
        .select(
            local_time(F.col("w.start"), offset).alias("window_start"),
            local_time(F.col("w.end"), offset).alias("window_end"), "type", "punches", "verified", "cost",
        )
    )


def daily_costs(
    punches: DataFrame, records: DataFrame, event_time: str = "ts", delay: str = "2 hours", width: str = "1 day",
    offset: str = "+00:00", slots: int | None = None,
) -> DataFrame:
    """What is metered per local window and kind: every punch, and every completion record once however often it was read.

    Two stateful steps in one stream: ``submissions_once``, then windows over its rows and the punches."""
    reads = submissions_once(records, "submitted_at", delay, slots).select(
        F.col("submitted_at").alias("used_at"), F.when(F.col("drop_receipts") > 0, "record_with_photo").otherwise("record").alias("kind"))
    taps = punches.withWatermark(event_time, delay).select(F.col(event_time).alias("used_at"), F.lit("punch").alias("kind"))
    counted = taps.unionByName(reads).groupBy(local_window("used_at", width, offset).alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("units"))
    return metered_cost(counted).select(
        local_time(F.col("w.start"), offset).alias("window_start"), local_time(F.col("w.end"), offset).alias("window_end"),
        "kind", "units", (F.col("units") * F.col("cost")).cast("decimal(22,2)").alias("cost"))


#: Below the log: folded changes, and how far each folding reaches. Names with an underscore are no part of the log itself.
SNAPSHOTS, REACH = "_snapshots", "_reach"
CHANGE_ORDER = ["submitted_at", "submission_id", "batch"]


def write_completion_log(submissions: DataFrame, tables: Tables, path: str, checkpoint: str):
    """Turn streamed completion records into a log of appointment changes.

    The log starts with an empty batch, so it can be read before any record came.
    Each micro-batch is reduced to the newest record per event, joined to the
    booked appointments and written to its own folder, so a batch that is run
    again replaces what it wrote before. ``fold_completion_log`` applies the log,
    ``compact_completion_log`` keeps it short.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        records = batch.withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))
        # Stored, so that its size is known: a small batch is broadcast and the appointments are not shuffled for it.
        records = materialized(latest_per_key(records, ["submission_id"], ["submitted_at"]), "completion-batch")
        changes = completion_changes(matched_records(tables, records), "submitted_at")
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    write(submissions.sparkSession.createDataFrame([], submissions.schema), -1)
    return (
        submissions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def newest_snapshot(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """The batch up to which the log is folded, and the folder below ``_snapshots`` that holds it."""
    try:
        reached = spark.read.schema("upto bigint, folder string").parquet(f"{path}/{REACH}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    found = reached.orderBy(F.desc("upto")).first()
    return found and (found["upto"], found["folder"])


def logged_changes(spark: SparkSession, path: str) -> DataFrame:
    """The newest change of each appointment: of the snapshot, if there is one, and of the batches after it."""
    return folded(spark, path, newest_snapshot(spark, path))


def compact_completion_log(spark: SparkSession, path: str) -> int | None:
    """Fold all batches but the newest into a snapshot; return the batch it reaches.

    The newest batch stays out, as a stream that is started again may write it again. The snapshot counts once its folder
    is complete and a row says so; a fold that was cut off leaves a folder that nobody reads. Batches that are folded
    may be deleted.
    """
    newest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    before = newest_snapshot(spark, path)
    if newest is None or newest < 1 or (before and before[0] >= newest - 1):
        return before and before[0]
    folder = f"upto-{newest - 1}-{uuid.uuid4().hex}"
    folded(spark, path, before, newest - 1).write.parquet(f"{path}/{SNAPSHOTS}/{folder}")
    spark.createDataFrame([(newest - 1, folder)], "upto bigint, folder string").write.mode("append").parquet(f"{path}/{REACH}")
    return newest - 1


def folded(spark: SparkSession, path: str, snapshot: tuple[int, str] | None, last: int | None = None) -> DataFrame:
    """The newest change of each appointment among a snapshot and the batches after it, up to ``last``."""
    log = every = spark.read.parquet(path)
    if last is not None:
        log = log.where(F.col("batch") <= last)
    if snapshot:
        upto, folder = snapshot
        older = spark.read.schema(every.schema).parquet(f"{path}/{SNAPSHOTS}/{folder}")
        log = log.where(F.col("batch") > upto).unionByName(older)
    return latest_per_key(log, ["appointment_id"], CHANGE_ORDER)


def fold_completion_log(tables: Tables, path: str, as_of: dt.datetime) -> Tables:
    """The appointments with the newest logged change of each applied: the one
    submitted last, whichever batch brought it."""
    newest = logged_changes(tables.appointments.sparkSession, path).drop("batch", "submitted_at")
    return tables.replace(appointments=apply_changes(
        tables.appointments, newest, "appointment_id", as_of=as_of, keep_when_null=KEPT_WHEN_ABSENT
    ))


def run_to_files(stream: DataFrame, label: str, keyed: bool = False) -> DataFrame:
    """Run a stream over all available input into a Parquet sink and read it back.

    Sink and checkpoint lie in fresh paths below the shared folder. ``keyed`` streams
    get the state store they need.
    """
    spark: SparkSession = stream.sparkSession
    base = scratch_path(spark, label)
    with keyed_state(spark) if keyed else contextlib.nullcontext():
        running = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
