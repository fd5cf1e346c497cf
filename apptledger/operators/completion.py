"""Closing out appointments from shift stamps and completion records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.functions import naming
from apptledger.model import Tables
from apptledger.operators.changes import apply_changes, latest_per_key, one_per_key

# A record without these leaves what is already known.
KEPT_WHEN_ABSENT = [
    "docs_notarized", "tracking_no", "dropped_at", "scanbacks_sent_at", "scanbacks_required",
    "checked_in_at", "checked_out_at", "gps_verified", "checkin_distance_m",
]


def shift_stamps(shifts: DataFrame) -> DataFrame:
    """One row per shift with a punch: of several replies about a shift the one that knows most punches, then the latest."""
    columns = ["actual_in", "actual_out", "gps_verified", "checkin_distance_m"]
    known = shifts.where((F.col("punch_count") > 0) & F.col("shift_id").isNotNull()).select("shift_id", "punch_count", *columns)
    last = latest_per_key(known, ["shift_id"], ["punch_count", "actual_out", "actual_in", "gps_verified", "checkin_distance_m"])
    return last.select(F.col("shift_id").alias("shift_ext_id"), *columns)


def matched_records(tables: Tables, submissions: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """The newest record of each event next to its appointment.

    Repeats of an event are reduced first, so both sides are unique. With
    ``shifts`` given, records of shifts without a punch are left out: nobody was
    there.
    """
    newest = latest_per_key(
        submissions.where(F.col("event_ext_id").isNotNull()), ["event_ext_id"], ["submitted_at", "submission_id"]
    )
    booked = tables.appointments.where(F.col("event_ext_id").isNotNull()).select(
        "appointment_id", "event_ext_id", "shift_ext_id", F.col("notes").alias("old_notes")
    )
    rows = booked.join(newest, "event_ext_id")
    if shifts is None:
        none = F.lit(None)
        return rows.withColumns({
            "actual_in": none.cast("timestamp"), "actual_out": none.cast("timestamp"),
            "gps_verified": none.cast("int"), "checkin_distance_m": none.cast("int"),
        })
    return rows.join(shift_stamps(shifts), "shift_ext_id")


def appended(notes: Column, more: Column) -> Column:
    """Notes with an addition; an absent addition never erases them."""
    return F.nullif(F.concat(F.coalesce(notes, F.lit("")), F.coalesce(more, F.lit(""))), F.lit(""))


def completion_changes(records: DataFrame, *also: str) -> DataFrame:
    """What each matched record changes on its appointment, next to columns of the record asked for.

    A no-show takes the status, outcome, stamps and the details of the wait; drop,
    scan-back and document fields belong to work that took place.
    """
    status = naming.status_from_outcome("outcome")
    absent = F.coalesce(status == "no_show", F.lit(False))
    sent = F.coalesce(F.col("tracking_no").isNotNull() | (F.col("drop_receipts") > 0), F.lit(False))

    def worked(value: Column) -> Column:
        return F.when(~absent, value)

    return records.where(status.isNotNull()).select(
        "appointment_id",
        status.alias("status"),
        "outcome",
        "submission_id",
        worked(F.col("docs_notarized")).alias("docs_notarized"),
        worked(F.col("tracking_no")).alias("tracking_no"),
        worked(F.when(sent, F.col("submitted_at"))).alias("dropped_at"),
        worked(F.when(F.col("scanbacks") == "sent", F.col("submitted_at"))).alias("scanbacks_sent_at"),
        worked(F.when(F.col("scanbacks") == "not_required", 0).otherwise(1)).alias("scanbacks_required"),
        F.col("actual_in").alias("checked_in_at"),
        F.col("actual_out").alias("checked_out_at"),
        "gps_verified",
        "checkin_distance_m",
        appended(
            F.col("old_notes"), F.when(absent, F.col("no_sign_details")).otherwise(F.col("issues"))
        ).alias("notes"),
        *also,
    )


def apply_completions(
    tables: Tables, submissions: DataFrame, as_of: dt.datetime, shifts: DataFrame | None = None
) -> Tables:
    changes = completion_changes(matched_records(tables, submissions, shifts), "submitted_at")
    return tables.replace(appointments=apply_changes(
        tables.appointments, changes, "appointment_id", as_of=as_of, keep_when_null=KEPT_WHEN_ABSENT,
        newest_by=["submitted_at", "submission_id"],
    ))


def apply_no_shows(tables: Tables, reports: DataFrame, as_of: dt.datetime) -> Tables:
    """No-shows told by the business rather than by a record: ``appointment_id,
    outcome, details``, and ``requested_at`` where several may tell of one. Fees are left as they are."""
    reports = one_per_key(reports, "appointment_id")
    told = tables.appointments.select("appointment_id", F.col("notes").alias("old_notes")).join(
        reports.select("appointment_id", "outcome", "details"), "appointment_id"
    ).select(
        "appointment_id", F.lit("no_show").alias("status"), "outcome",
        appended(F.col("old_notes"), F.col("details")).alias("notes"),
    )
    return tables.replace(appointments=apply_changes(
        tables.appointments, told, "appointment_id", as_of=as_of, keep_when_null=["outcome"]
    ))


def record_stamps(tables: Tables, shifts: DataFrame, as_of: dt.datetime) -> Tables:
    """Copy shift stamps onto the appointments they belong to."""
    stamps = shift_stamps(shifts).withColumnsRenamed({"actual_in": "checked_in_at", "actual_out": "checked_out_at"})
    booked = tables.appointments.where(F.col("shift_ext_id").isNotNull()).select("appointment_id", "shift_ext_id")
    changes = booked.join(stamps, "shift_ext_id").drop("shift_ext_id")
    return tables.replace(appointments=apply_changes(
        tables.appointments, changes, "appointment_id", as_of=as_of,
        keep_when_null=["checked_in_at", "checked_out_at", "gps_verified", "checkin_distance_m"],
    ))


def record_drops(tables: Tables, drops: DataFrame, as_of: dt.datetime) -> Tables:
    """Packages handed over: ``appointment_no, dropped_at, tracking_no, shipping_carrier``.
    A carrier already on the row stays."""
    carriers = tables.appointments.select("appointment_no", F.col("shipping_carrier").alias("_had"))
    delta = carriers.join(one_per_key(drops, "appointment_no", ["dropped_at"]), "appointment_no").select(
        "appointment_no", "dropped_at", "tracking_no",
        F.coalesce("_had", "shipping_carrier").alias("shipping_carrier"),
    )
    return tables.replace(
        appointments=apply_changes(tables.appointments, delta, "appointment_no", as_of=as_of, newest_by=["dropped_at"])
    )


def record_scanbacks(tables: Tables, sent: DataFrame, as_of: dt.datetime) -> Tables:
    delta = sent.select("appointment_no", "scanbacks_sent_at")
    return tables.replace(
        appointments=apply_changes(tables.appointments, delta, "appointment_no", as_of=as_of, newest_by=["scanbacks_sent_at"])
    )
