"""Domain tables: schemas, allowed values and the ``Tables`` bundle.

``invoice_lines`` holds one row per line of an invoice; the JSON on an invoice's row is the first document of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed entries of the enumerated columns.
CLIENT_TYPES = ["signing_service", "title_escrow", "lender", "attorney", "direct", "other"]
SIGNING_TYPES = [
    "purchase", "refinance", "seller", "heloc", "reverse", "loan_mod",
    "gnw", "apostille", "hospital", "jail", "other",
]
STATUSES = ["requested", "confirmed", "completed", "no_show", "cancelled", "rescheduled"]
ACT_TYPES = ["acknowledgment", "jurat", "oath", "copy_certification", "signature_witnessing", "other"]
PAYOUT_TYPES = ["flat", "percent"]

# Statuses by what they mean downstream.
OPEN_STATUSES = ["requested", "confirmed"]
WORKED_STATUSES = ["completed", "no_show"]
BILLABLE_STATUSES = ["completed", "no_show", "cancelled"]

MONEY = "decimal(12,2)"
MILES = "decimal(9,2)"
RATE = "decimal(9,4)"

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "money": T.DecimalType(12, 2),
    "miles": T.DecimalType(9, 2),
    "rate": T.DecimalType(9, 4),
}

_COLUMNS = {
    "settings": "key string, value string",
    "clients": """
        client_id bigint, client_name string, client_type string, contact_name string, contact_phone string,
        billing_email string, payment_terms_days int, default_signing_fee money,
        default_print_fee money, default_trip_fee money, default_no_sign_fee money,
        notes string, is_active int, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "places": """
        place_id bigint, normalized_address string, address string, city string, state string, zip string,
        place_label string, location_ext_id bigint, access_notes string, is_repeat_site int,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "notaries": """
        notary_id bigint, notary_name string, email string, phone string, worker_ext_id bigint, is_owner int,
        commission_number string, commission_expires date, payout_type string, payout_value money,
        is_active int, notes string, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "appointments": """
        appointment_id bigint, appointment_no string, client_id bigint, client_order_ref string,
        signing_type string, signer_name string, signer_phone string, signer_count int, place_id bigint,
        scheduled_start timestamp_ntz, duration_minutes int, notary_id bigint, status string,
        signing_fee money, print_fee money, trip_fee money, no_sign_fee money,
        other_fee money, scanbacks_required int, scanbacks_sent_at timestamp_ntz,
        drop_deadline timestamp_ntz, shipping_carrier string, tracking_no string, dropped_at timestamp_ntz,
        access_notes string, event_ext_id bigint, shift_ext_id bigint, submission_id bigint,
        checked_in_at timestamp, checked_out_at timestamp, gps_verified int, checkin_distance_m int,
        outcome string, docs_notarized int, notes string, invoiced int, paid_out int, rescheduled_from bigint,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "journal_index": """
        entry_id bigint, appointment_id bigint, journal_book string, entry_no string, page_no string,
        act_type string, act_count int, notes string, created_at timestamp_ntz""",
    "mileage": """
        trip_id bigint, appointment_id bigint, trip_date date, miles miles, from_label string,
        to_label string, purpose string, rate rate, deduction money, created_at timestamp_ntz""",
    "invoices": """
        invoice_id bigint, client_id bigint, invoice_number string, invoice_date date, due_date date,
        total_amount money, paid int, paid_date date, sent_date date, line_items string, notes string,
        created_at timestamp_ntz""",
    "invoice_lines": """
        invoice_id bigint, line_no bigint, appointment_id bigint, appointment_no string, appointment_date date,
        signing_type string, status string, client_order_ref string, signing_fee money, print_fee money, trip_fee money,
        no_sign_fee money, other_fee money, billable_total money, shift_ext_id bigint, gps_verified int,
        checked_in_at timestamp""",
    "payouts": """
        payout_id bigint, notary_id bigint, appointment_id bigint, amount money, paid int,
        paid_date date, notes string, created_at timestamp_ntz""",
}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _schema(columns) for name, columns in _COLUMNS.items()}

LINES = "invoice_lines"


class Tables:
    """The base tables, each opened when first used. Where no invoice lines are given there are none.

    Transforms return a new bundle; nothing is mutated. A bundle that holds a
    part of the appointments knows them all as ``every_appointment``, for rules
    about the whole table.
    """

    def __init__(self, *, whole: Callable[[], DataFrame] | None = None, **frames: DataFrame | Callable[[], DataFrame]) -> None:
        if LINES not in frames and "invoices" in frames:
            frames[LINES] = lambda: self.invoices.sparkSession.createDataFrame([], SCHEMAS[LINES])
        if set(frames) != set(SCHEMAS):
            raise ValueError(f"expected exactly the tables {sorted(SCHEMAS)}")
        self._frames = frames
        self._whole = whole

    @property
    def every_appointment(self) -> DataFrame:
        return self._whole() if self._whole else self.appointments

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._frames:
            raise AttributeError(name)
        frame = self._frames[name]
        if callable(frame):
            frame = self._frames[name] = frame()
        return frame

    def replace(self, **changed: DataFrame) -> Tables:
        """A new bundle. Changed appointments lose the stored date column, which
        only describes rows as they were written."""
        if "appointments" in changed:
            changed["appointments"] = changed["appointments"].drop("appointment_date")
        return Tables(whole=self._whole, **{**self._frames, **changed})

    @staticmethod
    def names() -> list[str]:
        return list(SCHEMAS)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the declared schema, adding missing columns as NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[table].fields
    ])


def empty_tables(spark: SparkSession) -> Tables:
    return Tables(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})
