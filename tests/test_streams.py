"""Streams against the batch operators on the same input."""

from __future__ import annotations

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from apptledger.operators import completion
from apptledger.plans import reports
from apptledger.sources import feeds
from apptledger.sources import starschema as star
from apptledger.streaming import feeds as streams
from apptledger.streaming import keyed
from conftest import AS_OF, TESTDATA


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    """The events as three files, oldest first, so a stream takes three batches."""
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    events = star.read(spark, str(TESTDATA), "events")
    for low, high in [(0, 300), (300, 700), (700, 10**9)]:
        events.where(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def stream(spark, path):
    schema = star.read(spark, str(TESTDATA), "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_repeated_submissions_pass_once(spark, events_dir):
    rows = star.submission_records(stream(spark, events_dir), F.lit(1500)).withColumn(
        "submitted_at", F.col("submitted_at").cast("timestamp"))
    copies = rows.withColumn("c", F.explode(F.array_repeat(F.lit(1), F.when(F.col("submission_id") % 3 == 0, 200).otherwise(1))))
    out = streams.run_to_files(streams.submissions_once(copies.drop("c")), "t-once")
    assert out.count() == 1000 and out.select("submission_id").distinct().count() == 1000


def test_json_bodies_as_a_stream(spark, tmp_path):
    """The same reader on a stream of export bodies, repeats dropped."""
    path = str(tmp_path / "bodies")
    star.raw_submissions(spark, str(TESTDATA)).write.parquet(path)
    live = spark.readStream.schema("body string").parquet(path)
    records, _ = feeds.read_submissions(live)
    records = records.withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    out = streams.run_to_files(streams.submissions_once(records), "t-json")
    batch, _ = feeds.read_submissions(spark.read.parquet(path))
    assert out.count() == batch.select("submission_id").distinct().count() == 980


def test_commands_pass_once_across_batches(spark, events_dir):
    base = stream(spark, events_dir).select(
        F.col("ts").cast("timestamp").alias("issued_at"), F.lit("event-appt-1").alias("idempotency_key"))
    out = streams.run_to_files(streams.commands_once(base, ttl="60 days"), "t-commands", keyed=True)
    assert out.count() == 1


def test_shift_pairing_over_several_batches(spark, events_dir):
    events = star.read(spark, str(TESTDATA), "events")
    punches = star.punches(events)
    limit = punches.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS"))).first()[0]
    batch = punches.groupBy("shift_id").agg(
        F.min(F.when(F.col("type") == "in", F.col("ts"))).alias("i"),
        F.max(F.when(F.col("type") == "out", F.col("ts"))).alias("o"), F.max("ts").alias("last"),
    ).where(F.col("last") + F.expr("INTERVAL 1 DAY") <= F.lit(limit))
    done = {r.shift_id for r in batch.where("o >= i").collect()}
    open_ = {r.shift_id for r in batch.where("i IS NOT NULL AND (o IS NULL OR o < i)").collect()}
    on_site = streams.run_to_files(streams.time_on_site(star.punches(stream(spark, events_dir))), "t-site")
    alerts = streams.run_to_files(streams.missing_checkout(star.punches(stream(spark, events_dir))), "t-alerts")
    assert {r.shift_id for r in on_site.collect()} == done
    assert {r.shift_id for r in alerts.collect()} == open_
    assert on_site.where("seconds_on_site < 0").count() == 0


def test_hourly_counts_add_up(spark, events_dir):
    out = streams.run_to_files(
        streams.daily_counts(star.punches(stream(spark, events_dir)), width="1 hour"), "t-hourly")
    latest = out.agg(F.max("window_end")).first()[0]
    punches = star.punches(star.read(spark, str(TESTDATA), "events"))
    batch = punches.where(F.col("ts").cast("timestamp_ntz") < F.lit(latest).cast("timestamp_ntz"))
    assert out.agg(F.sum("punches")).first()[0] == batch.count()


def test_streamed_completions_equal_batch(spark, events_dir, tmp_path):
    tables = star.tables(spark, str(TESTDATA))
    live = star.submission_records(stream(spark, events_dir), star.booking_count(spark, str(TESTDATA))).drop("appointment_id")
    path = str(tmp_path / "log")
    streams.write_completion_log(
        live.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")), tables, path, str(tmp_path / "cp")
    ).awaitTermination()
    streamed = streams.fold_completion_log(tables, path, AS_OF).appointments
    records = star.submission_records(
        star.read(spark, str(TESTDATA), "events"), star.booking_count(spark, str(TESTDATA))).drop("appointment_id")
    batch = completion.apply_completions(tables, records, AS_OF).appointments
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_an_empty_feed_changes_nothing(spark, events_dir, tmp_path):
    tables = star.tables(spark, str(TESTDATA))
    nothing = star.submission_records(stream(spark, events_dir).where("event_id < 0"), F.lit(1500)).drop("appointment_id")
    path = str(tmp_path / "log")
    streams.write_completion_log(
        nothing.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")), tables, path, str(tmp_path / "cp")
    ).awaitTermination()
    after = streams.fold_completion_log(tables, path, AS_OF).appointments
    assert after.exceptAll(tables.appointments).count() == 0


def test_a_late_record_that_is_older_does_not_win(spark, tmp_path):
    """Records that arrive out of order give the same outcome as in one batch."""
    tables = star.tables(spark, str(TESTDATA))
    booked = tables.appointments.where("event_ext_id IS NOT NULL AND status = 'confirmed'").select("event_ext_id").limit(1)
    shape = star.submission_records(star.read(spark, str(TESTDATA), "events"), F.lit(1500)).drop("appointment_id", "event_ext_id")
    two = shape.where("submission_id IN (0, 1)").crossJoin(booked).withColumn("submitted_at", F.expr(
        "CASE submission_id WHEN 0 THEN TIMESTAMP '2026-09-08 12:00:00Z' ELSE TIMESTAMP '2026-09-08 11:00:00Z' END"))
    path, log = str(tmp_path / "records"), str(tmp_path / "log")
    for number in (0, 1):
        two.where(f"submission_id = {number}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    live = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.write_completion_log(live, tables, log, str(tmp_path / "cp")).awaitTermination()
    streamed = streams.fold_completion_log(tables, log, AS_OF).appointments
    records = spark.read.parquet(path).withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))
    batch = completion.apply_completions(tables, records, AS_OF).appointments
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert batch.join(booked, "event_ext_id").first().submission_id == 0


def test_a_shift_over_midnight_is_one_shift(spark, tmp_path):
    path = str(tmp_path / "punches")
    spark.sql("""SELECT * FROM VALUES
        (1L, 7L, 'in', true, TIMESTAMP '2026-09-08 23:30:00Z'), (1L, 7L, 'out', true, TIMESTAMP '2026-09-09 00:40:00Z'),
        (9L, 9L, 'out', true, TIMESTAMP '2026-09-12 09:00:00Z')
        AS t(shift_id, worker_id, type, gps_verified, ts)""").coalesce(1).write.parquet(path)
    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    paired = streams.run_to_files(streams.time_on_site(live), "t-night").collect()
    assert [(r.shift_id, str(r.work_date), r.seconds_on_site) for r in paired] == [(1, "2026-09-08", 4200)]
    assert streams.run_to_files(streams.missing_checkout(live), "t-night-alerts").count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_days_are_the_business_days(spark, tmp_path, zone):
    """A late afternoon shift west of UTC crosses midnight there, not here."""
    path = str(tmp_path / "punches")
    spark.sql("""SELECT * FROM VALUES
        (1L, 7L, 'in', true, TIMESTAMP '2026-09-08 16:30:00-07:00'), (1L, 7L, 'out', true, TIMESTAMP '2026-09-08 17:30:00-07:00'),
        (2L, 7L, 'in', false, TIMESTAMP '2026-09-09 09:00:00-07:00'), (9L, 9L, 'out', true, TIMESTAMP '2026-09-12 09:00:00-07:00')
        AS t(shift_id, worker_id, type, gps_verified, ts)""").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        paired = streams.run_to_files(streams.time_on_site(live, offset="-07:00"), "t-local").collect()
        alerts = streams.run_to_files(streams.missing_checkout(live, offset="-07:00"), "t-local-alerts").collect()
        counts = streams.run_to_files(streams.daily_counts(live, offset="-07:00"), "t-local-counts")
        first = counts.where("type = 'in'").orderBy("window_start").first()
        halves = streams.run_to_files(streams.daily_counts(live, width="30 minutes", offset="+05:45"), "t-halves")
        half = halves.where("type = 'in'").orderBy("window_start").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r.shift_id, str(r.work_date), r.seconds_on_site) for r in paired] == [(1, "2026-09-08", 3600)]
    assert [(r.shift_id, str(r.work_date)) for r in alerts] == [(2, "2026-09-09")]
    assert (str(first.window_start), str(first.window_end), first.punches) == (
        "2026-09-08 00:00:00", "2026-09-09 00:00:00", 1)
    assert str(half.window_start) == "2026-09-09 05:00:00", "16:30 at -07:00 is 05:15 at +05:45"


# Keyed state


def fed(spark, tmp_path, schema, batches):
    """A stream that reads each of ``batches`` as a batch of its own."""
    path = str(tmp_path / "fed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(day, clock):
    return dt.datetime.fromisoformat(f"2026-09-{day:02d}T{clock}+00:00")


COMMANDS = [
    ("a", 1, at(1, "08:00:00")), ("a", 2, at(1, "08:00:00")), ("b", 3, at(1, "09:00:00")), ("a", 4, at(2, "07:00:00")),
    ("a", 5, at(2, "07:59:59")), ("b", 6, at(2, "09:00:00")), ("a", 7, at(2, "09:00:00")), ("a", 8, at(3, "08:30:00")),
    (None, 9, at(3, "08:40:00")), ("a", 10, at(3, "09:00:00")), ("b", 11, at(9, "09:00:00")),
]


@pytest.mark.parametrize("cuts", [[], [4], [1, 2, 3, 5, 6, 8, 9]])
def test_a_command_passes_again_after_its_day(spark, tmp_path, cuts):
    """Dropped at 23 hours and a second short of 24, accepted at 24 and 25, however the rows fall into batches."""
    edges = [0, *cuts, len(COMMANDS)]
    live = fed(spark, tmp_path, "idempotency_key string, n long, issued_at timestamp",
               [COMMANDS[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)])
    out = streams.run_to_files(streams.commands_once(live), "t-ttl", keyed=True).collect()
    assert sorted(r.n for r in out) == [1, 3, 6, 7, 10, 11]
    assert {r.n: r.issued_at for r in out}[7] == at(2, "09:00:00").astimezone().replace(tzinfo=None)


PUNCH = "event_id long, shift_id long, worker_id long, type string, ts timestamp"
PUNCHES = [
    (1, 5, 9, "in", at(1, "08:00:00")), (2, 5, 9, "in", at(1, "08:01:00")), (3, 5, 9, "out", at(1, "12:00:00")),
    (4, 5, 9, "out", at(1, "12:01:00")), (5, 5, 9, "in", at(1, "12:40:00")), (6, 6, 9, "out", at(1, "13:00:00")),
    (7, 5, 9, "out", at(1, "17:00:00")), (8, 7, 8, "in", at(1, "22:00:00")), (9, 7, 8, "out", at(2, "01:00:00")),
    (10, 8, 8, "in", at(2, "06:00:00")), (11, 8, 8, "out", at(2, "19:00:00")), (12, 8, 8, "in", at(2, "19:30:00")),
    (13, 8, 8, "out", at(2, "20:00:00")), (14, 99, 1, "in", at(9, "00:00:00")),
]
STAYS = [(5, at(1, "08:00:00"), at(1, "12:00:00")), (5, at(1, "12:40:00"), at(1, "17:00:00")), (7, at(1, "22:00:00"), at(2, "01:00:00"))]


@pytest.mark.parametrize("order", [[range(14)], [[1, 0, 4, 2], [3, 6, 5, 7], range(8, 14)]])
def test_every_stay_is_one_row(spark, tmp_path, order):
    """Breaks count, repeated taps do not, batches may hold rows out of order; a stay of 13 hours is given up."""
    live = fed(spark, tmp_path, PUNCH, [[PUNCHES[i] for i in batch] for batch in order])
    out = streams.run_to_files(keyed.stays(live, delay="6 hours"), "t-stays", keyed=True)
    got = sorted((r.shift_id, r.i, r.o) for r in out.selectExpr("shift_id", "unix_seconds(actual_in) i", "unix_seconds(actual_out) o").collect())
    late = (8, at(2, "19:30:00"), at(2, "20:00:00"))
    assert got == sorted((s, int(i.timestamp()), int(o.timestamp())) for s, i, o in [*STAYS, late])
    batch = reports.stays(spark.createDataFrame(PUNCHES, PUNCH).where("shift_id < 8"))
    assert sorted((r.shift_id, r.seconds_on_site) for r in batch.collect()) == sorted(
        (s, int((o - i).total_seconds())) for s, i, o in STAYS)


def test_hours_of_the_stream_are_those_of_the_batch(spark, events_dir):
    live = star.punches(stream(spark, events_dir))
    streamed = streams.run_to_files(keyed.stays(live, longest_seconds=2 * 86400), "t-hours", keyed=True)
    last = star.read(spark, str(TESTDATA), "events").agg(F.max("ts").cast("timestamp")).first()[0]
    batch = reports.stays(star.punches(star.read(spark, str(TESTDATA), "events"))).where(F.col("actual_out") < F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    columns = ["shift_id", "worker_id", "actual_in", "actual_out", "seconds_on_site"]
    assert streamed.count() > 20
    assert sorted(map(tuple, streamed.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


FEED = PUNCH + ", starts_at timestamp, ends_at timestamp"
SHIFTS = [
    (1, 1, 7, "planned", at(1, "06:00:00"), at(1, "10:00:00"), at(1, "11:00:00")),  # nobody comes
    (2, 2, 7, "planned", at(1, "06:00:00"), at(1, "10:00:00"), at(1, "11:00:00")),  # in time, at the last moment
    (3, 3, 7, "planned", at(1, "06:00:00"), at(1, "10:00:00"), at(1, "11:00:00")),  # moved, then missed
    (4, 4, 7, "planned", at(1, "06:00:00"), at(1, "10:00:00"), at(1, "11:00:00")),  # cancelled
    (5, 3, 7, "planned", at(1, "09:00:00"), at(1, "15:00:00"), at(1, "16:00:00")),
    (6, 4, 7, "planned", at(1, "09:30:00"), None, None),
    (7, 2, 7, "in", at(1, "10:20:00"), None, None),                                  # and forgets to leave
    (8, 5, 7, "in", at(1, "10:25:00"), None, None),                                  # without a plan, leaves
    (9, 5, 7, "out", at(1, "22:25:00"), None, None),
    (10, 6, 7, "in", at(2, "08:00:00"), None, None),                                 # without a plan, stays
    (11, 1, 7, "in", at(2, "09:00:00"), None, None),                                 # late, after the planned end
    (12, 99, 7, "in", at(9, "00:00:00"), None, None),
]
ALERTS = [
    ("forgot_checkout", 1, at(2, "09:00:00"), at(2, "21:00:00")), ("forgot_checkout", 2, at(1, "10:20:00"), at(1, "11:15:00")),
    ("forgot_checkout", 6, at(2, "08:00:00"), at(2, "20:00:00")), ("not_checked_in", 1, at(1, "10:00:00"), at(1, "10:20:00")),
    ("not_checked_in", 3, at(1, "15:00:00"), at(1, "15:20:00")),
]


@pytest.mark.parametrize("cuts", [[], [3, 6, 8, 9, 11]])
def test_alerts_are_due_minutes_after_the_start(spark, tmp_path, cuts):
    edges = [0, *cuts, len(SHIFTS)]
    live = fed(spark, tmp_path, FEED, [SHIFTS[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)])
    out = streams.run_to_files(keyed.shift_alerts(live), "t-alerts", keyed=True)
    rows = out.selectExpr("kind", "shift_id", "unix_seconds(since) s", "unix_seconds(due_at) d", "unix_seconds(alert_at) a").collect()
    assert sorted((r.kind, r.shift_id, r.s, r.d) for r in rows) == [
        (k, s, int(i.timestamp()), int(d.timestamp())) for k, s, i, d in ALERTS]
    assert all(r.a - r.d == 600 for r in rows)


def test_costs_of_a_day_count_each_record_once(spark, events_dir):
    records = star.submission_records(stream(spark, events_dir), F.lit(1500)).withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    copies = records.withColumn("c", F.explode(F.array_repeat(F.lit(1), 3))).drop("c")
    out = streams.run_to_files(streams.daily_costs(star.punches(stream(spark, events_dir)), copies, width="1 hour"), "t-costs")
    latest = out.agg(F.max("window_end")).first()[0]
    events = star.read(spark, str(TESTDATA), "events").where(F.col("ts").cast("timestamp_ntz") < F.lit(latest).cast("timestamp_ntz"))
    units = {r.kind: r.u for r in out.groupBy("kind").agg(F.sum("units").alias("u")).collect()}
    assert units["punch"] == star.punches(events).count() and units["record"] + units["record_with_photo"] == events.count()


def test_a_compacted_log_folds_to_the_same(spark, events_dir, tmp_path):
    tables = star.tables(spark, str(TESTDATA))
    live = star.submission_records(stream(spark, events_dir), star.booking_count(spark, str(TESTDATA))).drop("appointment_id")
    path = str(tmp_path / "log")
    streams.write_completion_log(
        live.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")), tables, path, str(tmp_path / "cp")).awaitTermination()

    def folded():
        return sorted(map(str, streams.fold_completion_log(tables, path, AS_OF).appointments.collect()))

    before = folded()
    assert spark.read.parquet(path).agg(F.max("batch")).first()[0] == 2
    assert streams.compact_completion_log(spark, path) == 1
    assert folded() == before and streams.compact_completion_log(spark, path) == 1
    # The newest batch, which a restart repeats, is still read from the log; the folded ones are not.
    changes = streams.logged_changes(spark, path)
    plan = changes._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*batch#\d+ > 1\)", plan) and any("_snapshots" in f for f in changes.inputFiles())
    again = spark.read.parquet(f"{path}/batch=2").cache()
    assert again.count() > 0
    again.write.mode("overwrite").parquet(f"{path}/batch=2")
    assert folded() == before
    # A batch after it, and a fold of the fold.
    again.limit(5).withColumn("submitted_at", F.col("submitted_at") + F.expr("INTERVAL 100 DAYS")).withColumn(
        "outcome", F.lit("completed")).write.parquet(f"{path}/batch=3")
    after = folded()
    assert after != before and streams.compact_completion_log(spark, path) == 2 and folded() == after
