"""Rows entering the books: defaults, numbers and snapshots taken once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.functions import money, naming
from apptledger.functions.times import local_literal
from apptledger.model import MONEY, RATE, Tables, conform
from apptledger.operators.changes import apply_changes
from apptledger.operators.joins import lookup_join
from apptledger.operators.numbering import assign_ids
from apptledger.session import materialized
from apptledger.settings import setting

DEFAULTED_FEES = ["signing_fee", "print_fee", "trip_fee", "no_sign_fee"]


def fill_defaults(new: DataFrame, clients: DataFrame, settings: DataFrame) -> DataFrame:
    """Complete the duration, worker and fees a booking left open.

    Fees are snapshots of the client's defaults at this moment, else zero.
    """
    defaults = clients.select("client_id", *[f"default_{fee}" for fee in DEFAULTED_FEES])
    zero = F.lit(0).cast(MONEY)
    filled = lookup_join(new, defaults, "client_id", "left", spread_by=["appointment_id"]).withColumns({
        "duration_minutes": F.coalesce(
            "duration_minutes", setting(settings, "default_appointment_minutes"), F.lit(60)
        ),
        "notary_id": F.coalesce("notary_id", setting(settings, "default_notary_id")),
        **{fee: F.coalesce(F.col(fee), F.col(f"default_{fee}"), zero) for fee in DEFAULTED_FEES},
        "other_fee": F.coalesce(F.col("other_fee"), zero),
        "appointment_no": naming.appointment_number(),
    })
    return filled.drop(*[f"default_{fee}" for fee in DEFAULTED_FEES])


def admit_appointments(tables: Tables, new: DataFrame, as_of: dt.datetime) -> Tables:
    """Number, complete and append bookings.

    ``new`` carries a unique ``request_id`` and any appointment columns except
    the id. Ids continue after the highest one in use.
    """
    new = materialized(new, "bookings")  # numbering reads it twice
    last = tables.every_appointment.agg(F.max("appointment_id")).scalar()
    numbered = assign_ids(new, "request_id", "appointment_id", last)
    return tables.replace(appointments=tables.appointments.unionByName(
        complete_bookings(numbered, tables, as_of), allowMissingColumns=True
    ))


def complete_bookings(numbered: DataFrame, tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Bookings with ids, brought to the full schema with every default applied."""
    shaped = conform(numbered, "appointments").withColumns({
        "signing_type": F.coalesce("signing_type", F.lit("refinance")),
        "status": F.coalesce("status", F.lit("confirmed")),
        "signer_count": F.coalesce("signer_count", F.lit(1)),
        "scanbacks_required": F.coalesce("scanbacks_required", F.lit(0)),
        "invoiced": F.coalesce("invoiced", F.lit(0)),
        "paid_out": F.coalesce("paid_out", F.lit(0)),
        "created_at": local_literal(as_of),
        "updated_at": local_literal(as_of),
    })
    return conform(fill_defaults(shaped, tables.clients, tables.settings), "appointments")


def snapshot_trips(trips: DataFrame, settings: DataFrame) -> DataFrame:
    """Rate at the time of the trip and the deduction it gives."""
    rate = F.coalesce(F.col("rate"), setting(settings, "irs_mileage_rate"), F.lit(0).cast(RATE))
    return trips.withColumn("rate", rate.cast(RATE)).withColumn("deduction", money.deduction())


def add_trips(tables: Tables, trips: DataFrame) -> Tables:
    """Append trips; ``trips`` carries ids or a unique ``request_id``."""
    if "trip_id" not in trips.columns:
        trips = assign_ids(materialized(trips, "trips"), "request_id", "trip_id", tables.mileage.agg(F.max("trip_id")).scalar())
    shaped = conform(snapshot_trips(conform(trips, "mileage"), tables.settings), "mileage")
    return tables.replace(mileage=tables.mileage.unionByName(shaped))


def edit_trips(tables: Tables, edits: DataFrame) -> Tables:
    """Change miles and/or rate of existing trips and recompute those deductions.

    After an edit a NULL rate counts as zero; the setting is not consulted again.
    """
    edits = edits.withColumn("_edited", F.lit(1))
    base = tables.mileage.withColumn("_edited", F.lit(None).cast("int"))
    changed = apply_changes(base, edits, "trip_id")
    recomputed = F.when(F.col("_edited").isNotNull(), money.deduction()).otherwise(F.col("deduction"))
    return tables.replace(mileage=changed.withColumn("deduction", recomputed).drop("_edited"))


def add_journal_entries(tables: Tables, entries: DataFrame) -> Tables:
    if "entry_id" not in entries.columns:
        last = tables.journal_index.agg(F.max("entry_id")).scalar()
        entries = assign_ids(materialized(entries, "entries"), "request_id", "entry_id", last)
    shaped = conform(entries, "journal_index").withColumn("act_count", F.coalesce("act_count", F.lit(1)))
    return tables.replace(journal_index=tables.journal_index.unionByName(shaped))
