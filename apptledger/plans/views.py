"""The ten result views.

Every view takes the tables and, where it depends on the clock, an explicit
``as_of`` local time. Rows come unordered; sort at the edge.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptledger.functions import money, naming, times
from apptledger.model import BILLABLE_STATUSES, OPEN_STATUSES, WORKED_STATUSES, Tables
from apptledger.operators.joins import lookup_join, lookup_joins
from apptledger.settings import setting

BY_APPOINTMENT = ["appointment_id"]


def priced(appointments: DataFrame) -> DataFrame:
    """Appointments plus their local date and what they bill."""
    return appointments.withColumns({
        "appointment_date": F.to_date("scheduled_start"),
        "billable_total": money.billable_total(),
    })


def billable_appointments(tables: Tables) -> DataFrame:
    return priced(tables.appointments).select(
        "appointment_id", "appointment_no", "client_id", "client_order_ref", "signing_type", "status",
        "appointment_date", "scheduled_start", "notary_id", "signing_fee", "print_fee", "trip_fee",
        "no_sign_fee", "other_fee", "billable_total", "invoiced", "paid_out", "shift_ext_id", "submission_id",
    )


def in_days(appointments: DataFrame, first: dt.date, last: dt.date) -> Column:
    """Rows of these local dates; prunes partitions when the layout has the date."""
    condition = times.in_local_days("scheduled_start", first, last)
    if "appointment_date" in appointments.columns:
        condition = condition & F.col("appointment_date").between(
            times.date_literal(first), times.date_literal(last)
        )
    return condition


def appointments_between(tables: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Open appointments of these local dates, ready for dispatch."""
    return scheduled(tables, tables.appointments.where(
        F.col("status").isin(OPEN_STATUSES) & in_days(tables.appointments, first, last)))


def scheduled(tables: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` of appointments with all that dispatch needs."""
    offset = setting(tables.settings, "timezone_offset")
    clients = tables.clients.select("client_id", "client_name", "client_type")
    places = tables.places.select(
        "place_id", "address", "city", "state", "zip", "place_label",
        F.col("access_notes").alias("place_access_notes"), "is_repeat_site", "location_ext_id",
    )
    notaries = tables.notaries.select("notary_id", "notary_name", "worker_ext_id")
    rows = lookup_joins(
        rows,
        [(clients, "client_id", "inner"), (places, "place_id", "inner"), (notaries, "notary_id", "left")],
        BY_APPOINTMENT,
    )
    end = times.plus_minutes("scheduled_start", "duration_minutes")
    return rows.select(
        "appointment_id", "appointment_no", "status", "signing_type", "scheduled_start", "duration_minutes",
        times.with_offset("scheduled_start", offset).alias("start_iso"),
        times.with_offset(end, offset).alias("end_iso"),
        "client_id", "client_name", "client_type", "client_order_ref",
        "signer_name", "signer_phone", "signer_count",
        "place_id", "address", "city", "state", "zip",
        naming.street_address().alias("street_address"),
        naming.outbound_location_name().alias("outbound_location_name"),
        naming.outbound_event_title().alias("outbound_event_title"),
        "place_access_notes", "access_notes", "is_repeat_site",
        "location_ext_id", naming.needs("location_ext_id").alias("needs_location"),
        "event_ext_id", "shift_ext_id", naming.needs("shift_ext_id").alias("needs_shift"),
        "notary_id", "notary_name", "worker_ext_id",
        "signing_fee", "print_fee", "trip_fee", "scanbacks_required", "drop_deadline", "shipping_carrier", "notes",
        naming.idempotency_key("location", "place_id").alias("loc_idempotency_key"),
        naming.idempotency_key("event", "appointment_id").alias("event_idempotency_key"),
        naming.idempotency_key("shift", "appointment_id").alias("shift_idempotency_key"),
    )


def appointments_today(tables: Tables, as_of: dt.datetime) -> DataFrame:
    return appointments_between(tables, as_of.date(), as_of.date())


def appointments_upcoming(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Today and the six days after it."""
    return appointments_between(tables, as_of.date(), as_of.date() + dt.timedelta(days=6))


def drops_due(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Completed work whose package or scan-backs are still out, due within a day or late."""
    now = times.local_literal(as_of)
    due = tables.appointments.where(F.col("drop_deadline") <= times.local_literal(as_of + dt.timedelta(hours=24)))
    rows = drops_open(tables, due)
    return rows.withColumns({
        "overdue": (F.col("drop_deadline") < now).cast("int"), "hours_left": times.hours_until("drop_deadline", now),
    }).select(*[c for c in rows.columns if c not in DROPS_LAST], "overdue", "hours_left", *DROPS_LAST)


# Columns of ``drops_due`` that stand after those that depend on the time.
DROPS_LAST = ["notary_name", "notes"]


def drops_open(tables: Tables, appointments: DataFrame) -> DataFrame:
    """Of these appointments the completed ones whose package or scan-backs are still out."""
    scanbacks_pending = F.coalesce(F.col("scanbacks_required") == 1, F.lit(False)) & F.col("scanbacks_sent_at").isNull()
    rows = appointments.where((F.col("status") == "completed") & (F.col("dropped_at").isNull() | scanbacks_pending))
    clients = tables.clients.select("client_id", "client_name")
    notaries = tables.notaries.select("notary_id", "notary_name")
    rows = lookup_joins(
        rows, [(clients, "client_id", "inner"), (notaries, "notary_id", "left")], BY_APPOINTMENT
    )
    return rows.select(
        "appointment_id", "appointment_no", "client_name", "client_order_ref", "signing_type", "scheduled_start",
        "drop_deadline", "shipping_carrier", "tracking_no", "dropped_at", "scanbacks_required", "scanbacks_sent_at",
        scanbacks_pending.cast("int").alias("scanbacks_pending"),
        F.col("dropped_at").isNull().cast("int").alias("drop_pending"),
        "notary_name", "notes",
    )


def uninvoiced(tables: Tables) -> DataFrame:
    """Priced appointments that still have to be billed."""
    rows = tables.appointments.where((F.col("invoiced") == 0) & F.col("status").isin(BILLABLE_STATUSES))
    return priced(rows).where(F.col("billable_total") > 0)


def receivables_by_client(tables: Tables) -> DataFrame:
    """Uninvoiced work per client. Sums first, so a dominant client shuffles one
    partial row per task, then joins one row per client."""
    owed = uninvoiced(tables).groupBy("client_id").agg(
        F.count("appointment_id").alias("appointment_count"),
        F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("completed_count"),
        F.sum(F.when(F.col("status") == "no_show", 1).otherwise(0)).alias("no_show_count"),
        F.sum("billable_total").alias("total_billable"),
        F.min("appointment_date").alias("first_date"),
        F.max("appointment_date").alias("last_date"),
    )
    clients = tables.clients.select(
        "client_id", "client_name", "client_type", "contact_name", "billing_email", "payment_terms_days"
    )
    return clients.join(owed, "client_id")


def invoices_outstanding(tables: Tables, as_of: dt.datetime) -> DataFrame:
    today = as_of.date()
    return invoices_unpaid(tables).select(
        "*",
        money.days_past_due(today).alias("days_past_due"),
        money.aging_bucket(today).alias("aging_bucket"),
        F.coalesce((F.col("due_date") < times.date_literal(today)).cast("int"), F.lit(0)).alias("overdue"),
    )


def invoices_unpaid(tables: Tables) -> DataFrame:
    clients = tables.clients.select(
        "client_id", "client_name", "client_type", "contact_name", "billing_email", "payment_terms_days"
    )
    rows = lookup_join(
        tables.invoices.where(F.col("paid") == 0), clients, "client_id", spread_by=["invoice_id"]
    )
    return rows.select(
        "invoice_id", "invoice_number", "client_id", "client_name", "client_type", "contact_name", "billing_email",
        "payment_terms_days", "invoice_date", "due_date", "sent_date", "total_amount",
    )


def mileage_by_month(tables: Tables) -> DataFrame:
    return (
        tables.mileage.groupBy(times.month_key("trip_date").alias("month"))
        .agg(
            F.count("trip_id").alias("trips"),
            F.sum("miles").alias("miles"),
            F.sum("deduction").alias("deduction"),
            F.sum(F.when(F.col("appointment_id").isNull(), F.col("miles")).otherwise(0)).alias("non_appointment_miles"),
        )
    )


def payouts_due(tables: Tables) -> DataFrame:
    """Unpaid splits with each worker's total.

    The total is an aggregate joined back, not a window: a window would hold all
    of one worker's rows in a single task.
    """
    subs = tables.notaries.where(F.col("is_owner") == 0).select(
        "notary_id", "notary_name", "email", "payout_type", "payout_value"
    )
    due = tables.payouts.where(F.col("paid") == 0).select("payout_id", "notary_id", "appointment_id", "amount")
    work = priced(tables.appointments).select(
        "appointment_id", "appointment_no", "appointment_date", "signing_type", "status", "billable_total",
        F.col("invoiced").alias("client_invoiced"),
    )
    rows = lookup_join(due, subs, "notary_id", spread_by=["payout_id"]).join(work, "appointment_id")
    totals = rows.groupBy("notary_id").agg(F.sum("amount").alias("notary_total_due"))
    rows = lookup_join(
        rows, totals, "notary_id", "left", spread_by=["payout_id"], bound=tables.notaries, counted_in=due
    )
    return rows.select(
        "payout_id", "notary_id", "notary_name", "email", "payout_type", "payout_value", "appointment_id",
        "appointment_no", "appointment_date", "signing_type", "status", "billable_total", "amount",
        F.col("amount").isNull().cast("int").alias("needs_amount"), "notary_total_due", "client_invoiced",
    )


def payouts_missing(tables: Tables) -> DataFrame:
    """Finished work of subs without a payout row."""
    subs = tables.notaries.where(F.col("is_owner") == 0).select(
        "notary_id", "notary_name", "payout_type", "payout_value"
    )
    worked = priced(tables.appointments.where(F.col("status").isin(WORKED_STATUSES)))
    rows = lookup_join(worked, subs, "notary_id", spread_by=BY_APPOINTMENT)
    return rows.join(tables.payouts.select("appointment_id"), "appointment_id", "left_anti").select(
        "appointment_id", "appointment_no", "status", "appointment_date", "notary_id", "notary_name",
        "payout_type", "payout_value", "billable_total",
    )


def no_show_evidence(tables: Tables) -> DataFrame:
    rows = priced(tables.appointments.where(F.col("status") == "no_show"))
    clients = tables.clients.select("client_id", "client_name", "client_type", "billing_email")
    places = tables.places.select("place_id", "address", "city", "state", "zip")
    notaries = tables.notaries.select("notary_id", "notary_name")
    rows = lookup_joins(
        rows,
        [(clients, "client_id", "inner"), (places, "place_id", "inner"), (notaries, "notary_id", "left")],
        BY_APPOINTMENT,
    )
    return rows.select(
        "appointment_id", "appointment_no", "client_name", "client_type", "billing_email", "client_order_ref",
        "signing_type", "scheduled_start",
        times.with_offset("scheduled_start", setting(tables.settings, "timezone_offset")).alias("start_iso"),
        naming.street_address().alias("street_address"), "notary_name", "event_ext_id", "shift_ext_id",
        "submission_id", "checked_in_at", "checked_out_at", "gps_verified", "checkin_distance_m",
        times.minutes_between("checked_in_at", "checked_out_at").alias("minutes_on_site"),
        "outcome", "trip_fee", "no_sign_fee", "billable_total", "invoiced", "notes",
    )


# The order each view is listed in. Sorting is for display only.
LISTED_BY = {
    "appointments_today": [F.asc, ["scheduled_start"]],
    "appointments_upcoming": [F.asc, ["scheduled_start"]],
    "drops_due": [F.asc, ["drop_deadline"]],
    "receivables_by_client": [F.desc, ["total_billable"]],
    "invoices_outstanding": [F.asc, ["due_date"]],
    "mileage_by_month": [F.desc, ["month"]],
    "payouts_due": [F.asc, ["notary_name", "appointment_date"]],
    "payouts_missing": [F.asc, ["appointment_date"]],
    "no_show_evidence": [F.desc, ["scheduled_start"]],
}


# Views that depend on the clock.
NEEDS_TIME = {"appointments_today", "appointments_upcoming", "drops_due", "invoices_outstanding"}


def listed(name: str, rows: DataFrame) -> DataFrame:
    """A view's rows in the order it is read in."""
    if name not in LISTED_BY:
        return rows
    direction, columns = LISTED_BY[name]
    return rows.orderBy(*[direction(c) for c in columns])


def register_views(spark: SparkSession, tables: Tables, as_of: dt.datetime) -> None:
    """Make every table and view readable by name from SQL."""
    for name in Tables.names():
        getattr(tables, name).createOrReplaceTempView(name)
    for name, df in all_views(tables, as_of).items():
        df.createOrReplaceTempView(name)


def all_views(tables: Tables, as_of: dt.datetime) -> dict[str, DataFrame]:
    return {
        "billable_appointments": billable_appointments(tables),
        "appointments_today": appointments_today(tables, as_of),
        "appointments_upcoming": appointments_upcoming(tables, as_of),
        "drops_due": drops_due(tables, as_of),
        "receivables_by_client": receivables_by_client(tables),
        "invoices_outstanding": invoices_outstanding(tables, as_of),
        "mileage_by_month": mileage_by_month(tables),
        "payouts_due": payouts_due(tables),
        "payouts_missing": payouts_missing(tables),
        "no_show_evidence": no_show_evidence(tables),
    }


# What the views below leave to the time they are asked for, in SQL; ``as_of`` is the function's parameter.
_DAYS = "scheduled_start >= date_trunc('DAY', as_of) AND scheduled_start < date_trunc('DAY', as_of) + INTERVAL {} DAYS"
TIMED = {
    "appointments_today": ("appointments_open", "*", _DAYS.format(1)),
    "appointments_upcoming": ("appointments_open", "*", _DAYS.format(7)),
    "drops_due": (
        "drops_open",
        "* EXCEPT (notary_name, notes), CAST(drop_deadline < as_of AS INT) AS overdue, CAST(round(CAST(timestampdiff(SECOND, as_of, "
        "drop_deadline) AS DECIMAL(18,0)) / 360, 0) / 10 AS DECIMAL(12,1)) AS hours_left, notary_name, notes",
        "drop_deadline <= as_of + INTERVAL 24 HOURS"),
    "invoices_outstanding": (
        "invoices_unpaid",
        "*, datediff(CAST(as_of AS DATE), due_date) AS days_past_due, "
        # How many of the limits have passed; without a due date all of them have.
        "element_at(array('current', '30', '60', '90+'), 1 + coalesce(size(filter(array(0, 30, 60), "
        "days -> datediff(CAST(as_of AS DATE), due_date) > days)) + 0 * datediff(CAST(as_of AS DATE), due_date), 3)) AS aging_bucket, "
        "coalesce(CAST(due_date < CAST(as_of AS DATE) AS INT), 0) AS overdue",
        "true"),
}


def register_functions(spark: SparkSession, tables: Tables) -> None:
    """Make every view a table function of SQL: ``SELECT * FROM receivables_by_client()``, and those that depend on
    the clock ask for it: ``SELECT * FROM drops_due(TIMESTAMP_NTZ '2026-09-30 14:36:00')``.

    The rows behind a function are a temporary view without the time; the time's conditions reach its scan.
    """
    undated = {
        "appointments_open": scheduled(tables, tables.appointments.where(F.col("status").isin(OPEN_STATUSES))),
        "drops_open": drops_open(tables, tables.appointments), "invoices_unpaid": invoices_unpaid(tables),
    }
    views = all_views(tables, dt.datetime(2000, 1, 1))
    for name, df in {**undated, **{n: v for n, v in views.items() if n not in TIMED}}.items():
        df.createOrReplaceTempView(f"{name}_rows")
    for name, df in views.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        rows, selected, condition = TIMED.get(name, (name, "*", "true"))
        parameter = "as_of TIMESTAMP_NTZ" if name in TIMED else ""
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter}) RETURNS TABLE ({columns}) "
            f"RETURN SELECT {selected} FROM {rows}_rows WHERE {condition}")
