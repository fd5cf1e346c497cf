"""Domain tables derived from the star-schema test tables.

``FIXTURES.md`` section B gives the rules. Only projections and lookups are
used, so the derived tables grow with their sources and every query over them
reads whole tables.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptledger.functions import money, naming, times
from apptledger.model import MONEY, RATE, SIGNING_TYPES, WORKED_STATUSES, Tables, conform
from apptledger.operators.admission import fill_defaults
from apptledger.operators.joins import lookup_join, lookup_joins
from apptledger.plans.views import priced
from apptledger.session import scratch_path
from apptledger.settings import seed_settings, setting

AS_OF = dt.datetime(2026, 9, 30, 14, 36)
FIRST_SLOT = dt.datetime(2026, 9, 1, 8, 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over the cores when they come in fewer files than there are.

    A small file is one task, which keeps text work on one core. Data in many
    files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def _money(amount: Column | int) -> Column:
    return (F.lit(amount) if isinstance(amount, int) else amount).cast(MONEY)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _div(c: Column, by: int) -> Column:
    return F.floor(c / F.lit(by)).cast("bigint")


@lru_cache(maxsize=8)
def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    kinds = {"MACHINERY": "signing_service", "BUILDING": "title_escrow", "AUTOMOBILE": "lender", "FURNITURE": "attorney"}
    return conform(read(spark, sf_dir, "customer").select(
        key.alias("client_id"),
        F.col("c_name").alias("client_name"),
        F.coalesce(F.try_element_at(naming.literal_map(kinds), segment), F.lit("direct")).alias("client_type"),
        F.when(key % 7 != 0, _text("Contact ", key)).alias("contact_name"),
        F.when(key % 9 != 0, _text("ap", key, "@clients.example")).alias("billing_email"),
        F.when(segment == "MACHINERY", 45).when(segment == "HOUSEHOLD", 0).otherwise(30).alias("payment_terms_days"),
        _money(100 + key % 5 * 25).alias("default_signing_fee"),
        _money(25).alias("default_print_fee"),
        F.when(key % 4 != 0, _money(50)).alias("default_trip_fee"),
        _money(75).alias("default_no_sign_fee"),
        F.when(key % 12 == 5, 0).otherwise(1).alias("is_active"),
    ), "clients")


@lru_cache(maxsize=8)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return conform(read(spark, sf_dir, "nation").select(
        key.alias("place_id"),
        _text(key, " Main St").alias("address"),
        F.col("n_name").alias("city"),
        F.when(key % 5 != 0, "WA").alias("state"),
        F.when(key % 3 != 0, (98000 + key).cast("string")).alias("zip"),
        F.when(key % 4 != 0, _text("Site ", F.col("n_name"))).alias("place_label"),
        F.when(key % 2 == 0, 9000 + key).alias("location_ext_id"),
        F.when(key % 3 == 1, _text("Gate code ", key)).alias("access_notes"),
        (key % 2).alias("is_repeat_site"),
    ).withColumn("normalized_address", naming.normalized_address()), "places")


@lru_cache(maxsize=8)
def notaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return conform(read(spark, sf_dir, "supplier").select(
        key.alias("notary_id"),
        F.col("s_name").alias("notary_name"),
        _text("n", key, "@roster.example").alias("email"),
        F.when(key % 8 != 3, 600 + key).alias("worker_ext_id"),
        (key == 0).cast("int").alias("is_owner"),
        _text("C", 20430000 + key).alias("commission_number"),
        F.when(key % 10 != 9, F.date_add(F.lit("2026-08-01").cast("date"), (key % 400).cast("int")))
        .alias("commission_expires"),
        F.when(key % 3 == 0, "flat").when(key % 3 == 1, "percent").alias("payout_type"),
        F.when(key % 3 == 0, _money(90)).when(key % 3 == 1, _money(70)).alias("payout_value"),
        F.when(key % 15 == 7, 0).otherwise(1).alias("is_active"),
    ), "notaries")


@lru_cache(maxsize=8)
def raw_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings as they arrive: fees, duration and worker partly open."""
    key, client = F.col("o_orderkey"), F.col("o_custkey")
    roster_size = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    start = times.plus_minutes(times.local_literal(FIRST_SLOT), (key % 60 * 1440 + _div(key, 60) % 40 * 15).cast("int"))
    return conform(read(spark, sf_dir, "orders").select(
        key.alias("appointment_id"),
        F.when(key % 500 == 499, _text("KEEP-", key)).alias("appointment_no"),
        client.alias("client_id"),
        F.when(key % 13 != 0, _text("ORD-", key)).alias("client_order_ref"),
        F.element_at(F.array(*[F.lit(t) for t in SIGNING_TYPES]), (key % 11 + 1).cast("int")).alias("signing_type"),
        _text("Signer ", key).alias("signer_name"),
        F.concat(F.lit("425-555-"), naming.zero_padded(key % 10000)).alias("signer_phone"),
        (1 + key % 2).alias("signer_count"),
        (key % 25).alias("place_id"),
        start.alias("scheduled_start"),
        F.when(key % 7 != 0, 15 * (1 + key % 8)).alias("duration_minutes"),
        F.when(key % 6 != 0, key % roster_size).alias("notary_id"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", F.when(client % 2 == 0, "no_show").otherwise("cancelled"))
        .when(client % 3 == 0, "requested").when(client % 3 == 1, "confirmed").otherwise("rescheduled").alias("status"),
        F.when(key % 3 != 0, _money(100 + key % 7 * 25)).alias("signing_fee"),
        F.when(client % 5 == 0, _money(35)).alias("other_fee"),
        (key % 2).alias("scanbacks_required"),
        (key % 4 == 0).cast("int").alias("invoiced"),
        F.when((key % 8 != 0) & (_div(key, 8) % 4 == 0), key - 1).alias("rescheduled_from"),
        F.when(key % 3 != 1, F.lit(7000000000) + key).alias("event_ext_id"),
        F.when(key % 3 != 1, F.lit(8000000000) + key).alias("shift_ext_id"),
        F.when(key % 10 != 9, _text("note ", key)).alias("notes"),
        F.lit(0).alias("paid_out"),
    ), "appointments")


@lru_cache(maxsize=8)
def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings with defaults filled, plus drop times, stamps and record fields."""
    config = star_settings(spark)
    filled = fill_defaults(raw_appointments(spark, sf_dir), clients(spark, sf_dir), config)
    key, status = F.col("appointment_id"), F.col("status")
    day = F.to_date("scheduled_start").cast("timestamp_ntz")
    east = times.offset_seconds(setting(config, "timezone_offset"))
    arrived = times.local_seconds("scheduled_start") - east + (key % 41 - 20) * 60
    left = arrived + (30 + key % 60) * 60 + key % 50
    return conform(filled.withColumns({
        "scanbacks_sent_at": F.when(key % 3 == 0, F.timestamp_add("HOUR", F.lit(15), day)),
        "drop_deadline": F.when(key % 3 != 1, F.timestamp_add("HOUR", F.lit(17), day)),
        "dropped_at": F.when(key % 5 != 0, F.timestamp_add("HOUR", F.lit(16), day)),
        "shipping_carrier": F.when(key % 4 == 0, "FedEx").when(key % 4 == 1, "UPS").when(key % 4 == 2, "courier"),
        "tracking_no": F.when(key % 5 != 0, _text("TRK ", key)),
        "access_notes": F.when(key % 4 == 2, _text("ring ", key)),
        "submission_id": F.when(status.isin(WORKED_STATUSES), F.lit(3000000000) + key),
        "checked_in_at": F.timestamp_seconds(arrived),
        "checked_out_at": F.when(key % 9 != 0, F.timestamp_seconds(left)),
        "gps_verified": F.when(key % 10 == 0, 0).otherwise(1),
        "checkin_distance_m": key % 100,
        "outcome": F.when(status == "completed", "completed").when(status == "no_show", "borrower_no_show"),
        "docs_notarized": F.when(status == "completed", 1 + key % 9),
    }), "appointments")


def journal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = {
        "RO": "acknowledgment", "RF": "jurat", "NO": "oath",
        "NF": "copy_certification", "AF": "signature_witnessing", "AO": "other",
    }
    count, first = F.col("l_quantity").cast("bigint"), F.col("l_partkey")
    first_no, last_no = F.format_string("%06d", first), F.format_string("%06d", first + count - 1)
    return conform(read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"),
        F.col("l_orderkey").alias("appointment_id"),
        _text("Book ", F.col("l_orderkey") % 9).alias("journal_book"),
        F.when(count == 1, first_no).otherwise(F.concat(first_no, F.lit("-"), last_no)).alias("entry_no"),
        F.element_at(naming.literal_map(acts), F.concat("l_returnflag", "l_linestatus")).alias("act_type"),
        count.alias("act_count"),
    ), "journal_index")


def mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("appointment_id"),
        F.to_date("l_shipdate").alias("trip_date"),
        F.col("l_quantity").cast("decimal(9,2)").alias("miles"),
        F.when(F.col("l_linestatus") == "O", F.lit("0.70")).otherwise(F.lit("0.67")).cast(RATE).alias("rate"),
    ).withColumn("deduction", money.deduction()), "mileage")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        key.alias("invoice_id"),
        F.col("o_custkey").alias("client_id"),
        F.concat(F.lit("INV-2026-"), naming.zero_padded(key)).alias("invoice_number"),
        F.date_add(F.lit("2026-06-01").cast("date"), (key % 120).cast("int")).alias("invoice_date"),
        _money(100 + key % 900).alias("total_amount"),
        (key % 3 == 0).cast("int").alias("paid"),
    )
    terms = clients(spark, sf_dir).select("client_id", "payment_terms_days")
    rows = lookup_join(rows, terms, "client_id", spread_by=["invoice_id"])
    bill = F.col("invoice_id")
    return conform(rows.withColumns({
        "due_date": F.when(bill % 50 != 0, money.due_date("invoice_date", "payment_terms_days")),
        "sent_date": F.when(bill % 6 != 1, F.date_add("invoice_date", 1)),
    }), "invoices")


def payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = notaries(spark, sf_dir).where(F.col("is_owner") == 0).select("notary_id", "payout_type", "payout_value")
    worked = priced(appointments(spark, sf_dir)).where(
        F.col("status").isin(WORKED_STATUSES) & (F.col("appointment_id") % 4 != 3)
    )
    rows = lookup_join(worked, subs, "notary_id", spread_by=["appointment_id"])
    return conform(rows.select(
        F.col("appointment_id").alias("payout_id"), "notary_id", "appointment_id",
        money.payout_amount().alias("amount"),
        (F.col("appointment_id") % 4 == 2).cast("int").alias("paid"),
    ), "payouts")


def star_settings(spark: SparkSession) -> DataFrame:
    return seed_settings(spark, default_notary_id="0")


@lru_cache(maxsize=8)
def tables(spark: SparkSession, sf_dir: str) -> Tables:
    built = [clients, places, notaries, appointments, journal_index, mileage, invoices, payouts]
    return Tables(
        settings=partial(star_settings, spark),
        **{build.__name__: partial(build, spark, sf_dir) for build in built},
    )


# Feeds


def _shift_id(user: Column, ts: Column) -> Column:
    """One shift per user and calendar day, in the id range appointments use."""
    day = F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date"))
    return F.lit(8000000000) + user * 31 + day


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")


@lru_cache(maxsize=8)
def _closed_events(spark: SparkSession, sf_dir: str) -> str:
    """A copy of the events with a last check-in long after them, which lets every earlier day close."""
    events = read(spark, sf_dir, "events")
    last = events.groupBy().agg(F.max("ts").alias("last"))
    closing = last.select(
        F.lit(-1).alias("event_id"), F.lit(-1).alias("user_id"), F.lit("click").alias("event_type"),
        F.timestamp_add("DAY", F.lit(30), F.col("last")).alias("ts"), F.lit(0.0).alias("value"),
    )
    path = scratch_path(spark, "closed-events")
    closing = closing.select(*[
        (F.col(f.name) if f.name in closing.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields
    ])
    events.unionByName(closing).write.parquet(path)
    return path


def closed_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that ends, so that its last days are complete."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(_closed_events(spark, sf_dir))


PUNCH_TYPES = {"click": "in", "purchase": "out"}


def punches(events: DataFrame, types: dict[str, str] = PUNCH_TYPES) -> DataFrame:
    """Check-in and check-out punches, from a batch or a stream of events."""
    return events.where(F.col("event_type").isin(list(types))).select(
        "event_id",
        _shift_id(F.col("user_id"), F.col("ts")).alias("shift_id"),
        F.col("user_id").alias("worker_id"),
        F.element_at(naming.literal_map(types), F.col("event_type")).alias("type"),
        F.floor("value").cast("int").alias("distance_from_site_m"),
        (F.col("event_id") % 7 != 0).alias("gps_verified"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def planned_shifts(events: DataFrame) -> DataFrame:
    """Plans as a feed: a signup plans the user's shift some hours ahead, every fifth error takes a plan back."""
    key, at = F.col("event_id"), F.col("ts").cast("timestamp")
    starts = F.when(F.col("event_type") == "signup", F.timestamp_add("HOUR", (key % 4).cast("int"), at))
    return events.where((F.col("event_type") == "signup") | ((F.col("event_type") == "error") & (key % 5 == 0))).select(
        "event_id", _shift_id(F.col("user_id"), F.col("ts")).alias("shift_id"), F.col("user_id").alias("worker_id"),
        F.lit("planned").alias("type"), at.alias("ts"), starts.alias("starts_at"),
        F.timestamp_add("MINUTE", F.lit(90), starts).alias("ends_at"))


OUTCOME_LABELS = [
    "Completed", "Borrower no-show", "Signer refused / declined",
    "Rescheduled on site", "Documents issue - not signed", "Partial - some docs signed",
]


def submission_records(events: DataFrame, bookings: Column) -> DataFrame:
    """One completion record per event, about the event's appointment."""
    key = F.col("event_id")
    label = F.element_at(F.array(*[F.lit(x) for x in OUTCOME_LABELS]), (key % 6 + 1).cast("int"))
    appointment = key % bookings
    return events.select(
        key.alias("submission_id"),
        F.col("user_id").alias("worker_id"),
        appointment.alias("appointment_id"),
        (F.lit(7000000000) + appointment).alias("event_ext_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("submitted_at"),
        naming.option_key(label).alias("outcome"),
        F.get_json_object("props", "$.k").cast("int").alias("docs_notarized"),
        F.when(key % 3 == 0, "not_required").when(key % 3 == 1, "sent").otherwise("pending").alias("scanbacks"),
        F.when(key % 4 == 1, _text("TRK ", key)).alias("tracking_no"),
        F.when(key % 5 == 2, _text("issue ", key)).alias("issues"),
        F.when((key % 6).isin(1, 2, 4), _text("waited ", key % 60, " min")).alias("no_sign_details"),
        (key % 3).cast("int").alias("drop_receipts"),
    )


def booking_count(spark: SparkSession, sf_dir: str) -> Column:
    return read(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()


@lru_cache(maxsize=8)
def raw_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export bodies as JSON text: one record each, repeated in every tenth body,
    cut off in every fiftieth."""
    events = spread(read(spark, sf_dir, "events"), "event_id")
    records = submission_records(events, booking_count(spark, sf_dir))
    photo = F.struct(F.lit("drop_receipt").alias("field"), F.lit("https://cdn.example/r.jpg").alias("cdn_url"))
    record = F.struct(
        "submission_id", "worker_id", F.col("event_ext_id").alias("event_id"),
        F.col("submitted_at").cast("string").alias("submitted_at"),
        F.struct(
            "outcome", "docs_notarized", F.array(F.lit("state_driver_license")).alias("id_types"), "scanbacks",
            "tracking_no", "issues", "no_sign_details",
        ).alias("data"),
        F.array_repeat(photo, F.col("drop_receipts")).alias("media"),
    )
    repeats = F.when(F.col("submission_id") % 10 == 0, 2).otherwise(1)
    body = F.to_json(F.struct(F.array_repeat(record, repeats).alias("submissions")))
    cut = F.concat(F.lit('{"submissions":[{"submission_id":'), F.col("submission_id").cast("string"))
    return records.select(F.when(F.col("submission_id") % 50 == 7, cut).otherwise(body).alias("body"))


@lru_cache(maxsize=8)
def raw_shift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift status replies as JSON text: first check-in and last check-out."""
    events = read(spark, sf_dir, "events")
    kind, ts = F.col("event_type"), F.col("ts")
    punch = F.struct(
        F.when(kind == "click", "in").otherwise("out").alias("type"),
        (F.col("event_id") % 7 != 0).alias("gps_verified"),
        F.floor("value").cast("int").alias("distance_from_site_m"),
    )
    shifts = events.groupBy(
        _shift_id(F.col("user_id"), ts).alias("shift_id"), F.col("user_id").alias("worker_id")
    ).agg(
        F.min(F.when(kind == "click", ts)).alias("first_in"),
        F.max(F.when(kind == "purchase", ts)).alias("last_out"),
        F.min_by(punch, F.when(kind == "click", ts)).alias("punch_in"),
        F.max_by(punch, F.when(kind == "purchase", ts)).alias("punch_out"),
    )
    return shifts.select(F.to_json(F.struct(
        "shift_id", "worker_id",
        F.when(F.col("last_out").isNotNull(), "checked_out").when(F.col("first_in").isNotNull(), "checked_in")
        .otherwise("missed").alias("status"),
        F.concat(times.local_text("first_in"), F.lit("+00:00")).alias("actual_in"),
        F.concat(times.local_text("last_out"), F.lit("+00:00")).alias("actual_out"),
        F.array_compact(F.array("punch_in", "punch_out")).alias("punches"),
    )).alias("body"))


def thousands(amount: Column) -> Column:
    """``1,234.50``, as people write it."""
    return F.format_number(amount, 2)


@lru_cache(maxsize=8)
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmation messages written out from bookings, in three shapes."""
    key = F.col("appointment_id")
    town = F.translate("city", "_0123456789", " ABCDEFGHIJ").alias("city")  # as a town is written
    place = places(spark, sf_dir).select("place_id", "address", town, "state", "zip")
    client = clients(spark, sf_dir).select("client_id", "client_name")
    rows = spread(raw_appointments(spark, sf_dir), "appointment_id")
    rows = lookup_joins(rows, [(place, "place_id", "inner"), (client, "client_id", "inner")], ["appointment_id"])
    start = F.col("scheduled_start")
    hour, minute = F.hour(start), F.minute(start)
    half = F.when(hour >= 12, "pm").otherwise("am")
    hour12 = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    long_clock = F.concat(hour12, F.format_string(":%02d ", minute), F.upper(half))
    short_clock = F.concat(hour12, F.when(minute > 0, F.format_string(":%02d", minute)).otherwise(""), F.lit(" "), half)
    month = F.element_at(F.array(F.lit("Sep"), F.lit("Oct")), F.month(start) - 8)
    slash_date = _text(F.month(start), "/", F.dayofmonth(start))
    said_type = F.replace(F.col("signing_type"), F.lit("_"), F.lit(" "))
    fee, zip_ = F.col("signing_fee"), F.coalesce(F.concat(F.lit(" "), F.col("zip")), F.lit(""))
    scans = F.col("scanbacks_required") == 1

    dashed = F.concat_ws(
        " — ",
        F.concat(F.lit("Order "), F.col("client_order_ref")),
        F.upper(said_type),
        F.concat(F.lit("Signing party: Sam Signer, ("), F.regexp_replace("signer_phone", "^(\\d+)-", "$1) ")),
        _text(month, " ", F.dayofmonth(start), ", 2026 ", long_clock, " local"),
        _text(F.col("address"), ", ", F.col("city"), F.coalesce(F.concat(F.lit(", "), F.col("state")), F.lit("")), zip_),
        F.when(fee.isNotNull(), F.concat(F.lit("Pays $"), thousands(fee), F.lit(" + $25.00 print"))),
        F.when(scans, "send scan-backs the same afternoon"),
        F.when(key % 2 == 0, "hand to FedEx by 5:00 PM"),
        _text("Loan reference 31-", 50000 + key % 40000),
    )
    noted = F.concat(
        F.col("client_name"), F.lit(" emailed: "), said_type, F.lit(" papers for "), slash_date, F.lit(" "), short_clock,
        F.lit(", to be signed at the branch, "), F.col("address"), F.lit(", "), F.col("city"), zip_, F.lit("."),
        F.coalesce(F.concat(F.lit(" File "), F.col("client_order_ref"), F.lit(".")), F.lit("")),
        F.coalesce(F.concat(F.lit(" They print, and pay $"), thousands(fee), F.lit(".")), F.lit(" They print.")),
        F.when(scans, " Scan-backs please.").otherwise(" No scan-backs please."),
    )
    comma = F.concat_ws(
        ", ",
        F.concat(F.col("client_name"), F.coalesce(F.concat(F.lit(" order "), F.col("client_order_ref")), F.lit(" order"))),
        F.concat(F.when(F.col("signing_type") == "refinance", "refi").otherwise(said_type), F.lit(" on "), slash_date,
                 F.lit(" at "), short_clock),
        F.concat(F.lit("meet Sam Signer on "), F.col("signer_phone")),
        F.concat(F.col("address"), F.lit(" "), F.col("city"), zip_),
        F.when(fee.isNotNull(), F.concat(F.lit("fee $"), thousands(fee), F.lit(" + $25 print"))),
        F.when(scans, "needs scanbacks"),
        F.when(key % 2 == 0, "UPS by 6:30 pm"),
    )
    return rows.select(
        key.alias("message_id"),
        F.when(key % 9 < 3, dashed).when(key % 9 < 6, noted).otherwise(comma).alias("text"),
    )


# Rows with faults, for the quality rules


@lru_cache(maxsize=8)
def faulty_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables with some values broken in every way a rule looks for."""
    t = tables(spark, sf_dir)

    def broken(df: DataFrame, key: str, changes: dict[str, tuple[int, Column]]) -> DataFrame:
        """Per column: every n-th row gets the given value."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return df.withColumns({
            c: F.when(F.col(key) % n == 0, value.cast(kinds[c])).otherwise(F.col(c))
            for c, (n, value) in changes.items()
        })

    null, stray = F.lit(None), F.lit(10**12)
    return t.replace(
        clients=broken(t.clients, "client_id", {
            "client_type": (11, F.lit("escrow company")), "client_name": (13, null)}),
        places=broken(t.places, "place_id", {"normalized_address": (10, F.lit("1 main st"))}),
        notaries=broken(t.notaries, "notary_id", {
            "payout_type": (9, F.lit("hourly")), "worker_ext_id": (7, F.lit(1))}),
        appointments=broken(t.appointments, "appointment_id", {
            "signing_type": (101, F.lit("refi")), "status": (103, F.lit("done")),
            "duration_minutes": (107, F.lit(10)), "place_id": (109, stray), "notary_id": (113, stray),
            "client_id": (127, null), "appointment_no": (131, F.lit("A-DUP")), "shift_ext_id": (137, F.lit(42)),
            "rescheduled_from": (139, stray),
        }).withColumn("duration_minutes", F.when(F.col("appointment_id") % 149 == 0, 480 * 2)
                      .otherwise(F.col("duration_minutes"))),
        journal_index=broken(t.journal_index, "entry_id", {
            "act_type": (151, F.lit("ack")), "act_count": (157, F.lit(0)), "appointment_id": (163, stray)}),
        mileage=broken(t.mileage, "trip_id", {
            "miles": (167, F.lit(-1)), "appointment_id": (173, stray)}),
        invoices=broken(t.invoices, "invoice_id", {
            "client_id": (179, stray), "invoice_number": (181, F.lit("INV-DUP"))}),
        payouts=broken(t.payouts, "payout_id", {"notary_id": (17, F.lit(0)), "appointment_id": (191, F.lit(1))}),
    )
