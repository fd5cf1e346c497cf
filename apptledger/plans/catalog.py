"""Every registered query, by name: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.functions import naming, times
from apptledger.functions.times import local_text
from apptledger.model import Tables
from apptledger.operators import (
    admission,
    billing,
    changes,
    completion,
    joins,
    lookups,
    payouts,
    places,
    presence,
    privacy,
    quality,
    scheduling,
    upkeep,
    usage,
)
from apptledger.plans import reports, views
from apptledger.session import materialized, scratch_path
from apptledger.sources import confirmations, documents, feeds
from apptledger.sources import starschema as star
from apptledger.sources.tables import load_tables, save_tables
from apptledger.streaming import feeds as streams
from apptledger.streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain result values: money as numbers, dates and local times as ISO text,
    instants as epoch seconds, all whole numbers of one width."""
    def plain(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return column.cast("bigint").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            return local_text(column).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_seconds(column).alias(field.name)
        return column

    return df.select(*[plain(f) for f in df.schema.fields])


def query(build: Query) -> Query:
    """Register ``build`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


@query
def billable_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.billable_appointments(star.tables(spark, sf_dir))


@query
def appointments_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.appointments_today(star.tables(spark, sf_dir), star.AS_OF)


@query
def appointments_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.appointments_upcoming(star.tables(spark, sf_dir), star.AS_OF)


@query
def drops_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.drops_due(star.tables(spark, sf_dir), star.AS_OF)


@query
def receivables_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.receivables_by_client(star.tables(spark, sf_dir))


@query
def invoices_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.invoices_outstanding(star.tables(spark, sf_dir), star.AS_OF)


@query
def mileage_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mileage_by_month(star.tables(spark, sf_dir))


@query
def payouts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.payouts_due(star.tables(spark, sf_dir))


@query
def payouts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.payouts_missing(star.tables(spark, sf_dir))


@query
def no_show_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.no_show_evidence(star.tables(spark, sf_dir))


# Billing and money


@query
def invoice_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.invoice_run(star.tables(spark, sf_dir), star.AS_OF)


@query
def invoice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.tables(spark, sf_dir)
    return billing.invoice_documents(tables, billing.invoice_run(tables, star.AS_OF))


def _billed(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame]:
    """The tables after a billing run, and the invoices it made, which are stored as every step on the way to a document uses them."""
    tables = star.tables(spark, sf_dir)
    after = billing.apply_invoice_run(tables, star.AS_OF)
    made = after.invoices.join(tables.invoices.select("invoice_id"), "invoice_id", "left_anti")
    terms = tables.clients.select("client_id", "payment_terms_days")
    return after, materialized(joins.lookup_join(made, terms, "client_id", spread_by=["invoice_id"]), "billed")


@query
def invoice_documents_after_the_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.invoice_documents(*_billed(spark, sf_dir))


@query
def invoice_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the JSON that a run left."""
    return billing.explode_line_items(billing.invoice_documents(*_billed(spark, sf_dir)))


@query
def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_invoices(*_billed(spark, sf_dir))


@query
def payment_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late invoices fifty days after a billing run, the new ones among them."""
    after = billing.apply_invoice_run(star.tables(spark, sf_dir), star.AS_OF)
    return documents.render_reminders(after, star.AS_OF + dt.timedelta(days=50))


@query
def payout_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_statements(star.tables(spark, sf_dir))


@query
def no_show_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_no_show_notes(star.tables(spark, sf_dir))


@query
def mark_invoiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every appointment after billing all clients with open work."""
    tables = star.tables(spark, sf_dir)
    rows = billing.mark_invoiced(tables, billing.invoice_lines(tables).select("client_id"), star.AS_OF)
    return rows.select("appointment_id", "client_id", "status", "invoiced", "updated_at")


@query
def unbilled_but_invoiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.unbilled_but_invoiced(star.tables(spark, sf_dir))


@query
def mark_invoices_sent_and_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send what is unsent, then settle what is more than 60 days late."""
    tables = star.tables(spark, sf_dir)
    unsent = tables.invoices.where(F.col("sent_date").isNull())
    late = views.invoices_outstanding(tables, star.AS_OF).where(F.col("days_past_due") > 60)
    after = billing.mark_invoices_paid(billing.mark_invoices_sent(tables, unsent, star.AS_OF), late, star.AS_OF)
    return after.invoices.select("invoice_id", "invoice_number", "sent_date", "paid", "paid_date")


@query
def aging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.aging_summary(star.tables(spark, sf_dir), star.AS_OF)


@query
def outstanding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outstanding_summary(star.tables(spark, sf_dir), star.AS_OF)


@query
def payout_statement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.payout_statement_totals(star.tables(spark, sf_dir))


@query
def create_payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payouts.create_payouts(star.tables(spark, sf_dir), star.AS_OF).payouts.select(
        "payout_id", "notary_id", "appointment_id", "amount", "paid"
    )


@query
def mark_payouts_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settle every worker paid by percentage; shows the payouts and their appointments."""
    tables = star.tables(spark, sf_dir)
    after = payouts.mark_payouts_paid(tables, tables.notaries.where(F.col("payout_type") == "percent"), star.AS_OF)
    return after.payouts.select("payout_id", "appointment_id", "paid", "paid_date").join(
        after.appointments.select("appointment_id", "paid_out", "updated_at"), "appointment_id"
    )


@query
def month_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_total(star.tables(spark, sf_dir), "1998-09")


@query
def acts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.acts_summary(star.tables(spark, sf_dir))


@query
def acts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.acts_by_type(star.tables(spark, sf_dir))


@query
def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.day_summary(star.tables(spark, sf_dir), dt.date(2026, 9, 1), dt.date(2026, 10, 31))


# Admission


def _bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings that arrive again as new requests, without ids or numbers."""
    return star.raw_appointments(spark, sf_dir).withColumnRenamed("appointment_id", "request_id").drop(
        "appointment_no", "event_ext_id", "shift_ext_id", "rescheduled_from"
    )


@query
def admit_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = admission.admit_appointments(star.tables(spark, sf_dir), _bookings(spark, sf_dir), star.AS_OF)
    return after.appointments.select(
        "appointment_id", "appointment_no", "client_id", "scheduled_start", "duration_minutes", "notary_id",
        "signing_fee", "print_fee", "trip_fee", "no_sign_fee", "other_fee", "status", "created_at",
    )


@query
def add_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New trips without a rate: the current setting is taken and kept."""
    tables = star.tables(spark, sf_dir)
    new = tables.mileage.withColumns({"trip_id": F.col("trip_id") + 10**9, "rate": F.lit(None), "deduction": F.lit(None)})
    return admission.add_trips(tables, new).mileage.select("trip_id", "trip_date", "miles", "rate", "deduction")


@query
def edit_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply runs lose their rate, the longest trips get one mile less."""
    tables = star.tables(spark, sf_dir)
    one_each = changes.latest_per_key(tables.mileage, ["trip_id"], ["trip_date", "miles", "rate", "appointment_id"])
    tables = tables.replace(mileage=one_each)
    edits = one_each.where(F.col("appointment_id").isNull() | (F.col("miles") == 50)).select(
        "trip_id",
        F.when(F.col("miles") == 50, F.col("miles") - 1).otherwise(F.col("miles")).alias("miles"),
        F.when(F.col("appointment_id").isNotNull(), F.col("rate")).alias("rate"),
    )
    return admission.edit_trips(tables, edits).mileage.select("trip_id", "trip_date", "miles", "rate", "deduction")


@query
def add_journal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One oath per completed appointment added to the journal pointers."""
    tables = star.tables(spark, sf_dir)
    new = tables.appointments.where(F.col("status") == "completed").select(
        F.col("appointment_id").alias("request_id"), "appointment_id", F.lit("Book 9").alias("journal_book"),
        naming.zero_padded("appointment_id").alias("entry_no"), F.lit("oath").alias("act_type"),
    )
    return admission.add_journal_entries(tables, new).journal_index.select(
        "entry_id", "appointment_id", "journal_book", "entry_no", "act_type", "act_count"
    )


@query
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append clients, half of them known already and each offered twice."""
    base = star.clients(spark, sf_dir).select("client_id", "client_name", "client_type")
    offered = base.withColumn("client_id", F.col("client_id") * 2)
    return changes.insert_or_ignore(base, offered.unionByName(offered), ["client_id"])


@query
def fill_payout_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payouts with some amounts given and the rest computed from the split."""
    tables = star.tables(spark, sf_dir)
    given = F.when(F.col("payout_id") % 5 == 0, F.lit(42)).cast("decimal(12,2)")
    return payouts.fill_payout_amounts(tables.payouts.withColumn("amount", given), tables).select(
        "payout_id", "notary_id", "appointment_id", "amount"
    )


@query
def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key an appointment's outbound calls use."""
    tables = star.tables(spark, sf_dir)
    rows = joins.lookup_join(
        tables.appointments, tables.notaries.select("notary_id", "email"), "notary_id", "left",
        spread_by=["appointment_id"],
    )
    return rows.select(
        "appointment_id",
        naming.idempotency_key("location", "place_id").alias("location_key"),
        naming.idempotency_key("event", "appointment_id").alias("event_key"),
        naming.idempotency_key("assign", "event_ext_id").alias("assign_key"),
        naming.idempotency_key("shift", "appointment_id").alias("shift_key"),
        naming.idempotency_key("shift", "appointment_id", "-2").alias("swap_key"),
        naming.idempotency_key("cancel", "shift_ext_id").alias("cancel_key"),
        naming.idempotency_key("worker", "email").alias("worker_key"),
        F.lit(naming.FORM_KEY).alias("form_key"),
    )


# Scheduling


@query
def schedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.schedule_conflicts(star.tables(spark, sf_dir))


@query
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.tables(spark, sf_dir)
    first = star.FIRST_SLOT.date()
    return scheduling.conflict_pairs(tables, first, first + dt.timedelta(days=60), shown=present)


@query
def reschedule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.reschedule_chain(star.tables(spark, sf_dir).appointments)


@query
def reschedule_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.reschedule_links(star.tables(spark, sf_dir).appointments)


@query
def reschedule_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested appointments move three hours later."""
    tables = star.tables(spark, sf_dir)
    moves = tables.appointments.where(F.col("status") == "requested").select(
        "appointment_id", times.plus_minutes("scheduled_start", 180).alias("scheduled_start")
    )
    return scheduling.reschedule_same_day(tables, moves, star.AS_OF).appointments.select(
        "appointment_id", "appointment_no", "scheduled_start", "status", "updated_at"
    )


@query
def reschedule_new_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested appointments move a week on, the repeat sites with a late fee."""
    tables = star.tables(spark, sf_dir)
    moves = tables.appointments.where(F.col("status") == "requested").select(
        "appointment_id", times.plus_days("scheduled_start", 7).alias("new_start"),
        F.when(F.col("place_id") % 2 == 1, F.lit(50)).cast("decimal(12,2)").alias("late_fee"),
    )
    return scheduling.reschedule_new_day(tables, moves, star.AS_OF).appointments.select(
        "appointment_id", "appointment_no", "client_id", "client_order_ref", "place_id", "scheduled_start", "status",
        "signing_fee", "trip_fee", "other_fee", "rescheduled_from", "shift_ext_id", "invoiced",
    )


@query
def cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed appointments are cancelled; some owe a print fee."""
    tables = star.tables(spark, sf_dir)
    requests = tables.appointments.where(F.col("status") == "confirmed").select(
        "appointment_id", F.when(F.col("scanbacks_required") == 1, F.col("print_fee")).alias("other_fee")
    )
    after = scheduling.cancel(tables, requests, star.AS_OF)
    return views.billable_appointments(after).select("appointment_id", "status", "other_fee", "billable_total")


@query
def conflicting_cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellations sent from two places, which differ in the fee of every seventh appointment."""
    rows = star.tables(spark, sf_dir).appointments.where(F.col("status") == "confirmed")
    fee = F.when((F.col("appointment_id") % 7 == 0) & (F.col("place") == 2), 20).otherwise(10)
    requests = rows.select("appointment_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).select(
        "appointment_id", fee.alias("other_fee"))
    return changes.conflicting_requests(requests, "appointment_id")


@query
def swap_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner's open appointments go to worker 1, with the calls that takes."""
    tables = star.tables(spark, sf_dir)
    open_ = tables.appointments.where((F.col("notary_id") == 0) & F.col("status").isin("requested", "confirmed"))
    requests = open_.select("appointment_id", F.lit(1).cast("bigint").alias("notary_id"))
    after = scheduling.swap_worker(tables, requests, star.AS_OF).appointments
    calls = scheduling.swap_calls(requests, tables.appointments).drop("notary_id")
    return after.select("appointment_id", "notary_id", "shift_ext_id").join(calls, "appointment_id", "left")


@query
def link_external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.tables(spark, sf_dir)
    links = tables.appointments.where(F.col("shift_ext_id").isNull()).select(
        "appointment_id", (F.col("appointment_id") + 7500000000).alias("event_ext_id"),
        F.when(F.col("notary_id") != 0, F.col("appointment_id") + 8500000000).alias("shift_ext_id"),
    )
    return scheduling.link_external_ids(tables, links, star.AS_OF).appointments.select(
        "appointment_id", "event_ext_id", "shift_ext_id", "updated_at"
    )


@query
def dispatch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.dispatch_queue(star.tables(spark, sf_dir), star.AS_OF)


# Places


def _address_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as people type them: known sites spelled freely, the rest new."""
    key = F.col("c_custkey")
    site = key % 50
    address = F.concat(site.cast("string"), F.when(key % 2 == 0, "  Main St.").otherwise(" MAIN ST,"))
    return star.read(spark, sf_dir, "customer").select(
        key.alias("request_id"), F.col("c_name").alias("client_name"), address.alias("address"),
        F.concat(F.lit("Nation_"), site.cast("string")).alias("city"),
        F.when(site % 5 != 0, "wa").alias("state"),
        F.when(site % 3 != 0, (98000 + site).cast("string")).alias("zip"),
        (site % 2).cast("int").alias("is_repeat_site"),
    )


@query
def match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.match_places(_address_requests(spark, sf_dir), star.places(spark, sf_dir))


@query
def admit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = places.admit_places(star.tables(spark, sf_dir), _address_requests(spark, sf_dir), star.AS_OF)
    return after.places.select(
        "place_id", "normalized_address", "address", "city", "state", "zip", "place_label", "location_ext_id",
        "is_repeat_site",
    )


@query
def merge_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of regions 3 and 2 fold into the site before them, so some by way of another; shows appointments with
    the location they now use."""
    tables = star.tables(spark, sf_dir)
    merges = star.read(spark, sf_dir, "nation").where(F.col("n_nationkey") % 5 == 3).select(
        F.col("n_nationkey").cast("bigint").alias("place_id"),
        (F.col("n_nationkey") - 1).cast("bigint").alias("survivor_id"),
    )
    merges = merges.unionByName(star.read(spark, sf_dir, "nation").where(F.col("n_nationkey") % 5 == 2).select(
        F.col("n_nationkey").cast("bigint").alias("place_id"), (F.col("n_nationkey") - 1).cast("bigint").alias("survivor_id")))
    after = places.merge_places(tables, merges, star.AS_OF)
    return after.appointments.select("appointment_id", "place_id", "updated_at").join(
        after.places.select("place_id", "location_ext_id"), "place_id"
    )


@query
def link_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location ids for the sites that lack one, each told twice."""
    tables = star.tables(spark, sf_dir)
    links = tables.places.where(F.col("location_ext_id").isNull()).select(
        "place_id", (F.col("place_id") + 40_000).alias("location_ext_id"))
    after = places.link_locations(tables, links.unionByName(links), star.AS_OF)
    return after.places.select("place_id", "location_ext_id", "updated_at")


@query
def update_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting for every tenth client, added to the seed ones, one of which changes."""
    tables = star.tables(spark, sf_dir)
    values = tables.clients.where(F.col("client_id") % 10 == 0).select(
        F.concat(F.lit("terms_of_"), F.col("client_id").cast("string")).alias("key"),
        F.col("payment_terms_days").cast("string").alias("value"))
    values = values.unionByName(spark.createDataFrame([("default_notary_id", "7")], "key string, value string"))
    after = upkeep.update_settings(tables, values).settings
    return after.where((F.col("key") == "default_notary_id") | F.col("key").startswith("terms_of_"))


@query
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables written in the stored layout and read back: rows and sum of ids of each."""
    path = scratch_path(spark, "stored")
    save_tables(star.tables(spark, sf_dir), path)
    back = load_tables(spark, path)
    counts = [
        getattr(back, name).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(key).alias("ids"))
        for name, key in [
            ("clients", "client_id"), ("places", "place_id"), ("notaries", "notary_id"), ("appointments", "appointment_id"),
            ("journal_index", "entry_id"), ("mileage", "trip_id"), ("invoices", "invoice_id"), ("payouts", "payout_id")]
    ]
    return reduce(DataFrame.unionByName, counts)


def _listed(name: str) -> Query:
    """A view's rows in the order it is read in."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, view = star.tables(spark, sf_dir), getattr(views, name)
        return views.listed(name, view(tables, star.AS_OF) if name in views.NEEDS_TIME else view(tables))

    build.__name__ = f"listed_{name}"
    return build


for _name in views.LISTED_BY:
    query(_listed(_name))


# Feeds and completion


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.read_submissions(star.raw_submissions(spark, sf_dir))[0]


def _shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.read_shift_status(star.raw_shift_status(spark, sf_dir))[0]


@query
def read_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _submissions(spark, sf_dir)


@query
def unreadable_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.read_submissions(star.raw_submissions(spark, sf_dir))[1]


@query
def read_shift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifts(spark, sf_dir).drop("punches")


@query
def shift_punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.explode_punches(_shifts(spark, sf_dir))


_CLOSED_COLUMNS = [
    "appointment_id", "status", "outcome", "docs_notarized", "tracking_no", "dropped_at", "scanbacks_sent_at",
    "scanbacks_required", "submission_id", "checked_in_at", "checked_out_at", "gps_verified", "checkin_distance_m",
    "notes", "updated_at",
]


@query
def apply_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = completion.apply_completions(star.tables(spark, sf_dir), _submissions(spark, sf_dir), star.AS_OF)
    return after.appointments.select(*_CLOSED_COLUMNS)


@query
def close_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that also need a punched shift; stamps come with them."""
    after = completion.apply_completions(
        star.tables(spark, sf_dir), _submissions(spark, sf_dir), star.AS_OF, _shifts(spark, sf_dir)
    )
    return after.appointments.select(*_CLOSED_COLUMNS)


@query
def record_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = completion.record_stamps(star.tables(spark, sf_dir), _shifts(spark, sf_dir), star.AS_OF)
    return after.appointments.select(
        "appointment_id", "checked_in_at", "checked_out_at", "gps_verified", "checkin_distance_m", "updated_at"
    )


@query
def apply_no_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed appointments reported as no-shows."""
    tables = star.tables(spark, sf_dir)
    told = tables.appointments.where(F.col("status") == "confirmed").select(
        "appointment_id", F.lit("borrower_no_show").alias("outcome"), F.lit(" - nobody home").alias("details")
    )
    after = completion.apply_no_shows(tables, told, star.AS_OF)
    return views.no_show_evidence(after).select("appointment_id", "outcome", "billable_total", "notes")


@query
def record_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package due is dropped and its scan-backs sent; what is left due."""
    tables = star.tables(spark, sf_dir)
    due = views.drops_due(tables, star.AS_OF)
    now = times.local_literal(star.AS_OF)
    drops = due.where(F.col("drop_pending") == 1).select(
        "appointment_no", now.alias("dropped_at"), F.concat(F.lit("T"), "appointment_no").alias("tracking_no"),
        F.lit("DHL").alias("shipping_carrier"),
    )
    return completion.record_drops(tables, drops, star.AS_OF).appointments.select(
        "appointment_id", "appointment_no", "dropped_at", "tracking_no", "shipping_carrier", "updated_at"
    )


@query
def record_scanbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still due once every pending scan-back has been sent."""
    tables = star.tables(spark, sf_dir)
    sent = views.drops_due(tables, star.AS_OF).where(F.col("scanbacks_pending") == 1).select(
        "appointment_no", times.local_literal(star.AS_OF).alias("scanbacks_sent_at")
    )
    return views.drops_due(completion.record_scanbacks(tables, sent, star.AS_OF), star.AS_OF)


@query
def option_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that form options get from labels, here part names and event kinds."""
    parts = star.read(spark, sf_dir, "part")
    label = F.concat_ws(" / ", "p_name", "p_type", "p_brand")
    return parts.select("p_partkey", naming.option_key(label).alias("option_key"))


# Presence and cost


@query
def punctuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.punctuality(star.tables(spark, sf_dir), star.AS_OF)


@query
def checkin_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.checkin_eligibility(star.tables(spark, sf_dir), presence.CheckinPolicy(radius_m=60, slack_min=15))


@query
def checkout_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.checkout_reminders(star.tables(spark, sf_dir), presence.CheckinPolicy(), star.AS_OF)


@query
def waiting_for_checkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts never punched: stamps of the evenly numbered are taken away first."""
    tables = star.tables(spark, sf_dir)
    stamp = F.when(F.col("appointment_id") % 2 == 1, F.col("checked_in_at"))
    tables = tables.replace(appointments=tables.appointments.withColumn("checked_in_at", stamp))
    return presence.waiting_for_checkin(tables, star.AS_OF)


@query
def worker_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worker_hours(_shifts(spark, sf_dir).where(F.col("actual_out") >= F.col("actual_in")))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = star.submission_records(star.read(spark, sf_dir, "events"), star.booking_count(spark, sf_dir))
    return usage.metered_cost(usage.usage_records(star.tables(spark, sf_dir), reads.unionByName(reads)))


@query
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)


@query
def cost_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cost_by_month(_costs(spark, sf_dir))


@query
def cost_by_appointment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cost_by_appointment(_costs(spark, sf_dir))


# Lookups


@query
def newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each worker's five newest completion records."""
    once = changes.latest_per_key(_submissions(spark, sf_dir), ["submission_id"], ["submitted_at"])
    return lookups.newest_records(once, by="worker_id").select("worker_id", "submission_id", "submitted_at", "outcome")


@query
def submissions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of completion records, repeats included."""
    return lookups.submissions_between(_submissions(spark, sf_dir), dt.date(2024, 1, 8), dt.date(2024, 1, 14)).select(
        "submission_id", "worker_id", "submitted_at", "outcome"
    )


@query
def commissions_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.commissions_expiring(star.tables(spark, sf_dir), star.AS_OF.date())


@query
def trips_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.trips_between(star.tables(spark, sf_dir), dt.date(1998, 9, 1), dt.date(1998, 9, 30))


@query
def find_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find_clients(star.tables(spark, sf_dir), "customer#00000001", active_only=True)


@query
def active_notaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.active_notaries(star.tables(spark, sf_dir))


@query
def shifts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.shifts_between(_shifts(spark, sf_dir), dt.date(2024, 1, 5), dt.date(2024, 1, 11))
    return lookups.with_punches(rows).select("shift_id", "worker_id", "work_date", "punch_count")


@query
def worker_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.worker_day(star.tables(spark, sf_dir), 0, dt.date(2026, 9, 7))


@query
def booking_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an hour at ten on September 7 would collide with for the default worker."""
    return lookups.collisions(star.tables(spark, sf_dir), 0, dt.datetime(2026, 9, 7, 10), 60)


@query
def find_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find_journal(star.tables(spark, sf_dir), "Book 3", 112)


@query
def journal_entries_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per client: which pointers cover this entry of this book."""
    tables = star.tables(spark, sf_dir)
    questions = tables.clients.select(
        F.col("client_id").alias("question_id"), F.concat(F.lit("Book "), (F.col("client_id") % 9).cast("string")).alias("journal_book"),
        (F.col("client_id") % 300).alias("entry"))
    return lookups.journal_entries_for(tables, questions)


@query
def journal_for_no_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal pointers of appointments where nobody signed: there should be none in life."""
    tables = star.tables(spark, sf_dir)
    return lookups.journal_for(tables, tables.appointments.where(F.col("status") == "no_show"))


# Upkeep


@query
def change_client_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title offices pay 10 more from now on; what is booked keeps its fees."""
    tables = star.tables(spark, sf_dir)
    fees = tables.clients.where(F.col("client_type") == "title_escrow").select(
        "client_id", (F.col("default_signing_fee") + 10).alias("default_signing_fee"),
        F.lit(None).cast("decimal(12,2)").alias("default_trip_fee"),
    )
    after = upkeep.change_client_fees(tables, fees, star.AS_OF)
    owed = views.receivables_by_client(after).select("client_id", "total_billable")
    return after.clients.select("client_id", "default_signing_fee", "default_trip_fee", "updated_at").join(
        owed, "client_id", "left"
    )


@query
def deactivate_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.tables(spark, sf_dir)
    gone = tables.clients.where(F.col("client_type") == "direct")
    return upkeep.deactivate_clients(tables, gone, star.AS_OF).clients.select("client_id", "is_active", "updated_at")


def _row_ids(tables: Tables) -> DataFrame:
    """What each row of the changed tables still points at."""
    none = F.lit(None).cast("bigint")
    parts = [
        tables.appointments.select(
            F.lit("appointments").alias("table_name"), F.col("appointment_id").alias("id"),
            F.col("notary_id").alias("a"), F.col("rescheduled_from").alias("b")),
        tables.payouts.select(F.lit("payouts"), "payout_id", "notary_id", "appointment_id"),
        tables.invoices.select(F.lit("invoices"), "invoice_id", "client_id", none),
        tables.clients.select(F.lit("clients"), "client_id", none, none),
        tables.notaries.select(F.lit("notaries"), "notary_id", none, none),
        tables.journal_index.select(F.lit("journal_index"), "entry_id", "appointment_id", none),
        tables.mileage.select(F.lit("mileage"), "trip_id", "appointment_id", none),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union


@query
def delete_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attorney's account is deleted, with all that hangs on it."""
    tables = star.tables(spark, sf_dir)
    return _row_ids(upkeep.delete_clients(tables, tables.clients.where(F.col("client_type") == "attorney")))


@query
def delete_notaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.tables(spark, sf_dir)
    return _row_ids(upkeep.delete_notaries(tables, tables.notaries.where(F.col("is_active") == 0)))


@query
def delete_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.tables(spark, sf_dir)
    return _row_ids(upkeep.delete_appointments(tables, tables.appointments.where(F.col("status") == "cancelled")))


@query
def blocked_place_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that cannot go while appointments refer to them."""
    tables = star.tables(spark, sf_dir)
    return upkeep.delete_places(tables, tables.places)[1]


# Quality and privacy


@query
def all_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.all_violations(star.faulty_tables(spark, sf_dir))


@query
def start_text_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start texts as they come in, some with offsets, spaces or odd hours."""
    rows = star.spread(star.raw_appointments(spark, sf_dir), "appointment_id")
    text, key = times.local_text("scheduled_start"), F.col("appointment_id")
    said = (
        F.when(key % 9 == 0, F.concat(text, F.lit("-05:00")))
        .when(key % 9 == 1, F.concat(text, F.lit("Z")))
        .when(key % 9 == 2, F.replace(text, F.lit("T"), F.lit(" ")))
        .when(key % 9 == 3, F.concat(F.substring(text, 1, 11), F.lit("29:00")))
        .when(key % 9 == 4, F.concat(F.substring(text, 1, 16), F.lit("PM")))
        .when(key % 9 == 5, F.substring(text, 1, 16))
        .otherwise(text)
    )
    return quality.check_start_text(rows.select("appointment_id", said.alias("said")), "appointment_id", "said")


@query
def existing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.existing_for(star.tables(spark, sf_dir), _address_requests(spark, sf_dir), "places")


@query
def existing_payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payouts asked for again: the one already there."""
    tables = star.tables(spark, sf_dir)
    asked = tables.appointments.select(F.col("appointment_id").alias("request_id"), "appointment_id")
    return quality.existing_for(tables, asked, "payouts")


@query
def find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound texts, some of them spoiled with private data."""
    tables = star.tables(spark, sf_dir)
    key = F.col("appointment_id")
    name = F.concat(F.lit("Signer "), key.cast("string"))
    spoiled = privacy.outbound_texts(tables).withColumns({
        "outbound_event_title": F.when(key % 19 == 0, F.concat("outbound_event_title", F.lit(" for "), name))
        .otherwise(F.col("outbound_event_title")),
        "outbound_location_name": F.when(key % 23 == 0, F.concat("outbound_location_name", F.lit(" 123-45-6789")))
        .when(key % 29 == 0, F.concat("outbound_location_name", F.lit(" Loan #: 0081")))
        .otherwise(F.col("outbound_location_name")),
    })
    return privacy.find_leaks(spoiled, tables)


@query
def sensitive_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts searched for identity and loan numbers."""
    return privacy.sensitive_notes(star.read(spark, sf_dir, "documents"), "doc_id", "text")


# Text


@query
def extract_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = confirmations.extract_confirmations(star.confirmations(spark, sf_dir), 2026)
    return fields.withColumn("missing_fields", F.array_join("missing_fields", ","))


@query
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken values back in house form."""
    rows = star.spread(star.raw_appointments(spark, sf_dir), "appointment_id")
    text, key = times.local_text("scheduled_start"), F.col("appointment_id")
    hour, minute = F.hour("scheduled_start"), F.minute("scheduled_start")
    clock = F.concat(
        F.when(hour > 12, hour - 12).otherwise(hour).cast("string"),
        F.when(minute > 0, F.format_string(":%02d", minute)).otherwise(""),
        F.when(hour >= 12, "pm").otherwise("am"),
    )
    said_type = F.when(F.col("signing_type") == "refinance", " Refi").when(
        F.col("signing_type") == "loan_mod", "Loan Mod").otherwise(F.col("signing_type"))
    said_start = F.when(key % 3 == 0, F.concat(text, F.lit("-05:00"))).when(
        key % 3 == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    return rows.select(
        "appointment_id", confirmations.canonical("signing_type", said_type).alias("signing_type"),
        confirmations.without_offset(said_start).alias("start_text"),
        confirmations.start_clock(clock).alias("start_clock"),
    )


@query
def normalized_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as typed, their cache key and the label a new place would get."""
    return _address_requests(spark, sf_dir).select(
        "request_id", naming.normalized_address().alias("normalized_address"), naming.place_label().alias("place_label")
    )


# Streams


def _stream_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record feed with every tenth record sent twice."""
    events = star.events_stream(spark, sf_dir)
    records = star.submission_records(events, star.booking_count(spark, sf_dir)).withColumn(
        "submitted_at", F.col("submitted_at").cast("timestamp")
    )
    again = F.when(F.col("submission_id") % 10 == 0, 2).otherwise(1)
    return records.withColumn("_copy", F.explode(F.sequence(F.lit(1), again))).drop("_copy")


@query
def stream_submissions_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = streams.submissions_once(_stream_submissions(spark, sf_dir))
    return streams.run_to_files(once, "submissions").select("submission_id", "worker_id", "submitted_at", "outcome")


@query
def stream_commands_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event creation commands, each retried once."""
    events = star.events_stream(spark, sf_dir)
    commands = events.select(
        naming.idempotency_key("event", "event_id").alias("idempotency_key"),
        F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("issued_at"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"),
    ).drop("attempt")
    return streams.run_to_files(streams.commands_once(commands), "commands", keyed=True)


@query
def stream_commands_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments under one key per worker: one passes, and the next one 24 hours or more after it."""
    commands = star.events_stream(spark, sf_dir).select(
        naming.idempotency_key("assign", "user_id").alias("idempotency_key"), "event_id",
        F.col("ts").cast("timestamp").alias("issued_at"))
    return streams.run_to_files(streams.commands_once(commands), "assignments", keyed=True)


@query
def stream_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stay of a shift, none given up within the day."""
    punches = star.punches(star.closed_events_stream(spark, sf_dir))
    return streams.run_to_files(keyed.stays(punches, longest_seconds=2 * 86400), "stays", keyed=True)


@query
def worker_hours_by_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worker_hours_by_stay(star.punches(star.read(spark, sf_dir, "events")))


@query
def stream_shift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing check-ins and check-outs when they are due, with plans that are moved and taken back."""
    events = star.closed_events_stream(spark, sf_dir)
    feed = star.punches(events).select("event_id", "shift_id", "worker_id", "type", "ts").unionByName(
        star.planned_shifts(events), allowMissingColumns=True)
    return streams.run_to_files(keyed.shift_alerts(feed), "alerts", keyed=True)


@query
def stream_daily_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, every tenth of them read twice, and punches: what they cost by day."""
    events = star.closed_events_stream(spark, sf_dir)
    records = star.submission_records(events, star.booking_count(spark, sf_dir)).withColumn(
        "submitted_at", F.col("submitted_at").cast("timestamp"))
    again = F.when(F.col("submission_id") % 10 == 0, 2).otherwise(1)
    read = records.withColumn("_copy", F.explode(F.sequence(F.lit(1), again))).drop("_copy")
    return streams.run_to_files(streams.daily_costs(star.punches(events), read), "daily-costs")


@query
def stream_time_on_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_to_files(streams.time_on_site(star.punches(star.closed_events_stream(spark, sf_dir))), "time-on-site")


@query
def stream_missing_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_to_files(streams.missing_checkout(star.punches(star.closed_events_stream(spark, sf_dir))), "no-checkout")


@query
def stream_missing_checkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punches and planned shifts in one feed; shifts nobody checked in to."""
    feed = star.punches(star.closed_events_stream(spark, sf_dir), {**star.PUNCH_TYPES, "signup": "scheduled"})
    return streams.run_to_files(streams.missing_checkin(feed), "no-checkin")


@query
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_to_files(streams.daily_counts(star.punches(star.closed_events_stream(spark, sf_dir))), "daily")


@query
def stream_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records streamed into a change log, which is then folded into the table."""
    tables = star.tables(spark, sf_dir)
    base = scratch_path(spark, "completions")
    records = streams.submissions_once(_stream_submissions(spark, sf_dir)).drop("appointment_id")
    streams.write_completion_log(records, tables, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    streams.compact_completion_log(spark, f"{base}/log")
    return streams.fold_completion_log(tables, f"{base}/log", star.AS_OF).appointments.select(
        "appointment_id", "status", "outcome", "submission_id", "dropped_at", "notes"
    )
