"""The key/value settings table, read as one typed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptledger.model import RATE

# The seed rows of a new business.
SEED_SETTINGS = [
    ("business_name", "My Mobile Notary"),
    ("timezone_offset", "-05:00"),
    ("state", None),
    ("default_notary_id", None),
    ("default_appointment_minutes", "60"),
    ("default_travel_buffer_minutes", "30"),
    ("invoice_due_days", "30"),
    ("invoice_prefix", "INV"),
    ("completion_form_id", None),
    ("irs_mileage_rate", "0.70"),
]

_TYPED = {
    "default_notary_id": "bigint",
    "default_appointment_minutes": "int",
    "default_travel_buffer_minutes": "int",
    "invoice_due_days": "int",
    "completion_form_id": "bigint",
    "irs_mileage_rate": RATE,
}


def seed_settings(spark: SparkSession, **overrides: str | None) -> DataFrame:
    values = {**dict(SEED_SETTINGS), **overrides}
    parameters = {f"v{i}": value for i, value in enumerate(values.values())}
    rows = ", ".join(f"('{key}', CAST(:v{i} AS STRING))" for i, key in enumerate(values))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS settings(key, value)", args=parameters)


def settings_row(settings: DataFrame) -> DataFrame:
    """One row, one typed column per known key; unusable text becomes NULL.

    ``has_invoice_prefix`` keeps "the row is absent" apart from "its value is NULL".
    """
    columns = []
    for key, _ in SEED_SETTINGS:
        value = F.max(F.when(F.col("key") == key, F.col("value")))
        if key in _TYPED:
            value = value.try_cast(_TYPED[key])
        columns.append(value.alias(key))
    has_prefix = F.coalesce(F.max(F.col("key") == "invoice_prefix"), F.lit(False)).alias("has_invoice_prefix")
    return settings.agg(*columns, has_prefix)


def setting(settings: DataFrame, key: str) -> Column:
    """A setting as a scalar subquery: evaluated once, no join with the facts."""
    return settings_row(settings).select(key).scalar()
