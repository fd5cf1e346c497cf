"""What may leave the books, and a check that nothing else does."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.functions import naming
from apptledger.model import Tables
from apptledger.operators.joins import lookup_join, lookup_joins
from apptledger.plans.views import appointments_upcoming

# Columns that never leave.
PRIVATE_COLUMNS = ["signer_name", "signer_phone", "access_notes", "place_access_notes", "commission_number"]

OUTBOUND_COLUMNS = [
    "appointment_id", "outbound_location_name", "street_address", "outbound_event_title", "start_iso", "end_iso",
    "location_ext_id", "needs_location", "worker_ext_id", "loc_idempotency_key", "event_idempotency_key",
    "shift_idempotency_key",
]
OUTBOUND_TEXTS = ["outbound_location_name", "street_address", "outbound_event_title"]

# Text that looks like an identity or loan number.
SENSITIVE_PATTERNS = {
    "social_security": r"\b\d{3}-\d{2}-\d{4}\b",
    "loan_number": r"(?i)\bloan\s*(#|no\.?|number)\s*:?\s*\w",
    "id_number": r"(?i)\b(licen[sc]e|passport|id)\s*(#|no\.?|number)\s*:?\s*\w",
    "long_number": r"(?:^|[^0-9A-Za-z])\d{12,19}(?:$|[^0-9A-Za-z])",
}


def outbound_safe(rows: DataFrame) -> DataFrame:
    """Only the columns on the allow list."""
    return rows.select(*[c for c in OUTBOUND_COLUMNS if c in rows.columns])


def dispatch_queue(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Upcoming appointments that were booked but never put on a phone."""
    return outbound_safe(appointments_upcoming(tables, as_of).where(F.col("needs_shift") == 1))


def outbound_texts(tables: Tables) -> DataFrame:
    """The texts each appointment sends out."""
    places = tables.places.select("place_id", "address", "city", "state", "zip", "place_label")
    rows = lookup_join(
        tables.appointments.select("appointment_id", "appointment_no", "signing_type", "place_id"),
        places, "place_id", spread_by=["appointment_id"],
    )
    return rows.select(
        "appointment_id",
        naming.outbound_location_name().alias("outbound_location_name"),
        naming.street_address().alias("street_address"),
        naming.outbound_event_title().alias("outbound_event_title"),
    )


def looks_sensitive(text: Column | str) -> Column:
    """Names of the patterns a text matches."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[
        F.when(text.rlike(pattern), F.lit(name)) for name, pattern in SENSITIVE_PATTERNS.items()
    ]))


def find_leaks(outbound: DataFrame, tables: Tables) -> DataFrame:
    """Outbound texts that carry that appointment's private data or look like an
    identity number: ``appointment_id, field, leak``."""
    access = tables.places.select("place_id", F.col("access_notes").alias("place_access_notes"))
    commissions = tables.notaries.select("notary_id", "commission_number")
    private = lookup_joins(
        tables.appointments.select(
            "appointment_id", "place_id", "notary_id", "signer_name", "signer_phone", "access_notes"
        ),
        [(access, "place_id", "left"), (commissions, "notary_id", "left")], ["appointment_id"],
    )
    secrets = PRIVATE_COLUMNS
    fields = [c for c in outbound.columns if c != "appointment_id"]
    texts = outbound.join(private.select("appointment_id", *secrets), "appointment_id").select(
        "appointment_id", *secrets,
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])),
    )
    held = [
        F.when((F.length(F.trim(F.col(s))) > 0) & F.col("text").contains(F.col(s)), F.lit(s)) for s in secrets
    ]
    return texts.select(
        "appointment_id", "field",
        F.explode(F.concat(F.array_compact(F.array(*held)), looks_sensitive("text"))).alias("leak"),
    )


def sensitive_notes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Free text that seems to hold an identity or loan number."""
    return rows.select(key, F.explode(looks_sensitive(column)).alias("leak"))
