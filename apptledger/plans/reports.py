"""Summaries built on the views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apptledger.functions import money, times
from apptledger.model import OPEN_STATUSES, Tables
from apptledger.operators.joins import lookup_join
from apptledger.plans import views


def aging_summary(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Open invoices by bucket; ``worst_first`` is the order to list them in."""
    return (
        tables.invoices.where(F.col("paid") == 0)
        .groupBy(money.aging_bucket(as_of.date()).alias("aging_bucket"))
        .agg(F.count(F.lit(1)).alias("invoices"), F.sum("total_amount").alias("amount"))
        .withColumn("worst_first", money.aging_rank())
    )


def outstanding_summary(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """One row: what is open, how much of it is late, and by how much at most."""
    late = F.col("due_date") < times.date_literal(as_of.date())
    return tables.invoices.where(F.col("paid") == 0).agg(
        F.count(F.lit(1)).alias("invoices"),
        F.sum("total_amount").alias("outstanding"),
        F.coalesce(F.sum(F.when(late, F.col("total_amount"))), F.lit(0)).alias("overdue"),
        F.max(money.days_past_due(as_of.date())).alias("most_days_past_due"),
    )


def payout_statement_totals(tables: Tables) -> DataFrame:
    """Per worker: open payouts, their sum, and how many still need an amount."""
    open_ = tables.payouts.where(F.col("paid") == 0).groupBy("notary_id").agg(
        F.count(F.lit(1)).alias("payouts"),
        F.sum("amount").alias("total_due"),
        F.sum(F.col("amount").isNull().cast("int")).alias("needs_amount"),
    )
    subs = tables.notaries.where(F.col("is_owner") == 0).select("notary_id", "notary_name", "email")
    return subs.join(open_, "notary_id")


def month_total(tables: Tables, month: str) -> DataFrame:
    """One month's driving with its supply runs and the rate it works out to."""
    year, number = (int(x) for x in month.split("-"))
    first = dt.date(year, number, 1)
    after = dt.date(year + number // 12, number % 12 + 1, 1)
    day = F.col("trip_date")
    trips = tables.mileage.where((day >= times.date_literal(first)) & (day < times.date_literal(after)))
    return views.mileage_by_month(tables.replace(mileage=trips)).withColumn(
        "average_rate", F.when(F.col("miles") > 0, F.round(F.col("deduction") / F.col("miles"), 4))
    )


def acts_summary(tables: Tables) -> DataFrame:
    """Notarial acts per appointment and type."""
    return tables.journal_index.groupBy("appointment_id", "act_type").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("act_count").alias("acts")
    )


def acts_by_type(tables: Tables) -> DataFrame:
    return tables.journal_index.groupBy("act_type").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("act_count").alias("acts")
    )


def day_summary(tables: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Open appointments by day, type and city, and how many lack a shift.

    Counts by place first and attaches the city to the counts.
    """
    counted = (
        tables.appointments
        .where(F.col("status").isin(OPEN_STATUSES) & views.in_days(tables.appointments, first, last))
        .groupBy(F.to_date("scheduled_start").alias("appointment_date"), "signing_type", "place_id")
        .agg(
            F.count(F.lit(1)).alias("appointments"),
            F.sum(F.col("shift_ext_id").isNull().cast("int")).alias("without_shift"),
            F.min("scheduled_start").alias("first_start"),
        )
    )
    cities = tables.places.select("place_id", "city")
    return (
        lookup_join(counted, cities, "place_id", spread_by=["appointment_date", "signing_type"])
        .groupBy("appointment_date", "signing_type", "city")
        .agg(
            F.sum("appointments").alias("appointments"),
            F.sum("without_shift").alias("without_shift"),
            F.min("first_start").alias("first_start"),
        )
    )


def worker_hours(shifts: DataFrame) -> DataFrame:
    """Hours per worker and date from check-in and check-out stamps."""
    seconds = F.unix_seconds("actual_out") - F.unix_seconds("actual_in")
    return (
        shifts.where(F.col("actual_in").isNotNull() & F.col("actual_out").isNotNull())
        .groupBy("worker_id", "work_date")
        .agg(F.count(F.lit(1)).alias("shifts"), F.sum(seconds).alias("seconds"))
        .withColumn("hours", F.round(F.col("seconds").cast("decimal(18,0)") / F.lit(3600), 2).cast("decimal(12,2)"))
    )


def stays(punches: DataFrame) -> DataFrame:
    """One row per stay of a shift: from a check-in to the next check-out.

    A check-in while a stay is open and a check-out while none is are repeated taps. A shift has few punches, so its
    window stays small.
    """
    known = punches.where(F.col("shift_id").isNotNull() & F.col("ts").isNotNull())
    order = Window.partitionBy("shift_id").orderBy("ts", "type", "event_id")
    turns = known.withColumn("_before", F.lag("type").over(order)).where(
        ((F.col("type") == "in") & ~F.col("_before").eqNullSafe("in")) | ((F.col("type") == "out") & (F.col("_before") == "in")))
    paired = turns.withColumns({
        "actual_out": F.lead("ts").over(order), "_after": F.lead("type").over(order)})
    return paired.where((F.col("type") == "in") & (F.col("_after") == "out")).select(
        "shift_id", "worker_id", F.col("ts").alias("actual_in"), "actual_out",
        (F.unix_seconds("actual_out") - F.unix_seconds("ts")).alias("seconds_on_site"))


def worker_hours_by_stay(punches: DataFrame, offset: str = "+00:00") -> DataFrame:
    """Hours per worker and local date from all stays, breaks left out."""
    return (
        stays(punches).groupBy("worker_id", times.local_time(F.col("actual_in"), offset).cast("date").alias("work_date"))
        .agg(F.count(F.lit(1)).alias("stays"), F.sum("seconds_on_site").alias("seconds"))
        .withColumn("hours", F.round(F.col("seconds").cast("decimal(18,0)") / F.lit(3600), 2).cast("decimal(12,2)"))
    )
