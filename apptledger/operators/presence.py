"""Punctuality and the check-in policy."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.functions import times
from apptledger.model import OPEN_STATUSES, Tables
from apptledger.settings import setting

# A radius below the threshold is raised to the floor.
RADIUS_THRESHOLD_M = 100
RADIUS_FLOOR_M = 91


# Accepted ranges of the policy.
RADIUS_RANGE_M = (10, 10000)
REMINDER_RANGE_MIN = (0, 60)


@dataclasses.dataclass(frozen=True)
class CheckinPolicy:
    radius_m: int = 150
    slack_min: int = 20
    remote_checkin: bool = False
    checkout_reminder_min: int = 15

    def __post_init__(self) -> None:
        for name, value, (low, high) in [
            ("radius_m", self.radius_m, RADIUS_RANGE_M),
            ("checkout_reminder_min", self.checkout_reminder_min, REMINDER_RANGE_MIN),
        ]:
            if not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}")

    @property
    def effective_radius_m(self) -> int:
        if self.radius_m < RADIUS_THRESHOLD_M:
            return max(self.radius_m, RADIUS_FLOOR_M)
        return self.radius_m


def seconds_early(offset: Column) -> Column:
    """How long before the scheduled start the check-in was; negative when late."""
    scheduled = times.local_seconds("scheduled_start") - times.offset_seconds(offset)
    return scheduled - F.unix_seconds("checked_in_at")


def punctuality(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Minutes early (or late, negative) and what is missing by now."""
    early = seconds_early(setting(tables.settings, "timezone_offset")).cast("decimal(18,0)")
    now = times.local_literal(as_of)
    end = times.plus_minutes("scheduled_start", "duration_minutes")
    presence = (
        F.when(F.col("checked_in_at").isNull() & (F.col("scheduled_start") < now), "not_checked_in")
        .when(F.col("checked_in_at").isNull(), "not_due")
        .when(F.col("checked_out_at").isNull() & (end < now), "forgot_checkout")
        .when(F.col("checked_out_at").isNull(), "on_site")
        .otherwise("done")
    )
    return tables.appointments.select(
        "appointment_id", "appointment_no", "notary_id", "scheduled_start",
        F.round(early / F.lit(60), 0).cast("int").alias("minutes_early"),
        (F.col("gps_verified") == 1).alias("gps_verified"),
        "checkin_distance_m", presence.alias("presence"),
    )


def checkin_allowed(policy: CheckinPolicy, early_seconds: Column, distance_m: Column | str) -> Column:
    """Not earlier than the slack, and within the radius unless check-in is remote."""
    in_time = early_seconds <= policy.slack_min * 60
    if policy.remote_checkin:
        return in_time
    return in_time & F.coalesce(times.col(distance_m) <= policy.effective_radius_m, F.lit(False))


def checkin_eligibility(tables: Tables, policy: CheckinPolicy) -> DataFrame:
    early = seconds_early(setting(tables.settings, "timezone_offset"))
    return tables.appointments.where(F.col("checked_in_at").isNotNull()).select(
        "appointment_id", "checkin_distance_m",
        (early <= policy.slack_min * 60).alias("in_time"),
        checkin_allowed(policy, early, "checkin_distance_m").alias("allowed"),
    )


def checkout_reminders(tables: Tables, policy: CheckinPolicy, as_of: dt.datetime) -> DataFrame:
    """Checked in, not checked out, and the reminder time after the end has come."""
    end = times.plus_minutes("scheduled_start", "duration_minutes")
    latest = times.local_literal(as_of - dt.timedelta(minutes=policy.checkout_reminder_min))
    return tables.appointments.where(
        F.col("checked_in_at").isNotNull() & F.col("checked_out_at").isNull() & (end <= latest)
    ).select("appointment_id", "appointment_no", "notary_id", "shift_ext_id", end.alias("scheduled_end"))


def waiting_for_checkin(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Open appointments with a shift whose start has passed without a check-in."""
    return tables.appointments.where(
        F.col("status").isin(OPEN_STATUSES) & F.col("shift_ext_id").isNotNull()
        & F.col("checked_in_at").isNull() & (F.col("scheduled_start") < times.local_literal(as_of))
    ).select("appointment_id", "appointment_no", "notary_id", "shift_ext_id", "scheduled_start")
