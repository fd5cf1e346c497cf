"""Metered costs of the schedule service."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.functions import times
from apptledger.model import MONEY, Tables
from apptledger.operators.changes import latest_per_key

# Price per metered record.
PRICES = {
    "geocode": Decimal("0.03"),
    "punch": Decimal("0.10"),
    "record": Decimal("0.05"),
    "record_with_photo": Decimal("0.15"),
    "worker_invite": Decimal("0.25"),
    "location_refine": Decimal("0.10"),
    "processed_timesheet": Decimal("0.10"),
}


def metered_cost(records: DataFrame) -> DataFrame:
    """Price records by their ``kind``; unknown kinds cost NULL."""
    prices = F.create_map(*[
        F.lit(x) if isinstance(x, str) else F.lit(x).cast(MONEY) for pair in PRICES.items() for x in pair
    ])
    return records.withColumn("cost", F.try_element_at(prices, F.col("kind")))


def usage_records(tables: Tables, submissions: DataFrame) -> DataFrame:
    """What has been metered: geocodes, invites, punches and record reads.

    A record is billed once however often it was read. Geocodes and invites count for the day their row was entered.
    """
    none = F.lit(None).cast("bigint")
    entered = F.to_date("created_at")
    geocodes = tables.places.where(F.col("location_ext_id").isNotNull()).select(
        F.lit("geocode").alias("kind"), F.col("place_id").alias("reference"), none.alias("appointment_id"),
        entered.alias("used_on"),
    )
    invites = tables.notaries.where(F.col("worker_ext_id").isNotNull()).select(
        F.lit("worker_invite").alias("kind"), F.col("notary_id").alias("reference"), none.alias("appointment_id"),
        entered.alias("used_on"),
    )
    punches = tables.appointments.select(
        "appointment_id", F.to_date("scheduled_start").alias("used_on"),
        F.explode(F.array_compact(F.array("checked_in_at", "checked_out_at"))),
    ).select(
        F.lit("punch").alias("kind"), F.col("appointment_id").alias("reference"), "appointment_id", "used_on"
    )
    read_once = latest_per_key(
        submissions.select("submission_id", "appointment_id", "submitted_at", "drop_receipts"),
        ["submission_id"], ["submitted_at"],
    )
    reads = read_once.select(
        F.when(F.col("drop_receipts") > 0, "record_with_photo").otherwise("record").alias("kind"),
        F.col("submission_id").alias("reference"), "appointment_id", F.to_date("submitted_at").alias("used_on"),
    )
    return geocodes.unionByName(invites).unionByName(punches).unionByName(reads)


def cost_by_month(costs: DataFrame) -> DataFrame:
    return costs.groupBy(times.month_key("used_on").alias("month"), "kind").agg(
        F.count(F.lit(1)).alias("units"), F.sum("cost").alias("cost")
    )


def cost_by_appointment(costs: DataFrame) -> DataFrame:
    return costs.where(F.col("appointment_id").isNotNull()).groupBy("appointment_id").agg(
        F.count(F.lit(1)).alias("units"), F.sum("cost").alias("cost")
    )
