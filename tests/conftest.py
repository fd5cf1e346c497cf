from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from apptledger.model import SCHEMAS, Tables, conform  # noqa: E402
from apptledger.operators.joins import BROADCAST_LIMIT_CONF  # noqa: E402
from apptledger.session import local_session  # noqa: E402
from apptledger.settings import seed_settings  # noqa: E402

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    # Rows made in a test have no size estimate; let them count as small.
    session.conf.set(BROADCAST_LIMIT_CONF, str(2**63 - 1))
    yield session
    session.stop()


@pytest.fixture()
def shuffled_joins(spark):
    """Treat every lookup as too large to broadcast."""
    before = spark.conf.get(BROADCAST_LIMIT_CONF)
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    yield
    spark.conf.set(BROADCAST_LIMIT_CONF, before)


def frame(spark, rows: list[dict], columns: list[str] | None = None):
    """Rows of plain values as text columns."""
    columns = columns or list(dict.fromkeys(c for row in rows for c in row))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    data = [tuple(None if row.get(c) is None else str(row[c]) for c in columns) for row in rows]
    return spark.createDataFrame(data, schema)


def table(spark, name: str, rows: list[dict]):
    """Rows of plain values as one of the declared tables."""
    return conform(frame(spark, rows, SCHEMAS[name].fieldNames()), name)


def make_tables(spark, settings: dict | None = None, **rows: list[dict]) -> Tables:
    frames = {name: table(spark, name, rows.get(name, [])) for name in Tables.names() if name != "settings"}
    return Tables(settings=seed_settings(spark, **(settings or {})), **frames)


def by_key(df, key: str) -> dict:
    return {row[key]: row for row in df.collect()}


AS_OF = dt.datetime(2026, 9, 30, 14, 36)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """The test tables in the stored layout."""
    from apptledger.sources import starschema
    from apptledger.sources.tables import load_tables, save_tables

    path = str(tmp_path_factory.mktemp("stored") / "tables")
    save_tables(starschema.tables(spark, str(TESTDATA)), path)
    return load_tables(spark, path)


def example_rows() -> dict[str, list[dict]]:
    """An invented week: five appointments, three clients."""
    fees = ["signing_fee", "print_fee", "trip_fee", "no_sign_fee", "other_fee"]

    def appt(i, client, kind, place, start, minutes, status, money, **more):
        return {
            "appointment_id": i, "appointment_no": f"A-2026-000{i}", "client_id": client, "signing_type": kind,
            "place_id": place, "scheduled_start": start, "duration_minutes": minutes, "notary_id": 1,
            "status": status, "signer_count": 1, "scanbacks_required": 0, "invoiced": 0, "paid_out": 0,
            **dict(zip(fees, money, strict=True)), **more,
        }

    return {
        "clients": [
            {"client_id": 1, "client_name": "Cedar Lane Closings", "client_type": "signing_service",
             "billing_email": "accounts@cedarlane.example", "payment_terms_days": 21, "default_signing_fee": 110,
             "default_print_fee": 15, "default_trip_fee": 38, "default_no_sign_fee": 64, "is_active": 1},
            {"client_id": 2, "client_name": "Mill Creek Settlement", "client_type": "title_escrow",
             "billing_email": "office@millcreek.example", "payment_terms_days": 14, "default_signing_fee": 165,
             "is_active": 1},
            {"client_id": 3, "client_name": "Direct - Abara household", "client_type": "direct",
             "payment_terms_days": 0, "is_active": 1},
        ],
        "places": [
            {"place_id": 1, "normalized_address": "340 birch ln fairmont or 97301", "address": "340 Birch Ln",
             "city": "Fairmont", "state": "OR", "zip": "97301", "place_label": "Signing - Birch Ln",
             "access_notes": "Side door", "is_repeat_site": 0},
            {"place_id": 2, "normalized_address": "77 harbor way fairmont or 97302", "address": "77 Harbor Way",
             "city": "Fairmont", "state": "OR", "zip": "97302", "place_label": "Mill Creek Settlement - Fairmont",
             "location_ext_id": 5502, "is_repeat_site": 1},
        ],
        "notaries": [
            {"notary_id": 1, "notary_name": "Owner", "worker_ext_id": 511, "is_owner": 1, "is_active": 1},
            {"notary_id": 2, "notary_name": "Flat Sub", "worker_ext_id": 512, "is_owner": 0, "payout_type": "flat",
             "payout_value": 90, "is_active": 1},
            {"notary_id": 3, "notary_name": "Percent Sub", "worker_ext_id": 513, "is_owner": 0,
             "payout_type": "percent", "payout_value": 70, "is_active": 1},
            {"notary_id": 4, "notary_name": "Unset Sub", "worker_ext_id": 514, "is_owner": 0, "is_active": 1},
        ],
        "appointments": [
            appt(1, 1, "heloc", 2, "2026-09-21T08:30", 75, "completed", (110, 15, 38, 64, 0),
                 client_order_ref="CL-301", checked_in_at="2026-09-21T08:20:40-07:00",
                 checked_out_at="2026-09-21T09:40:05-07:00", gps_verified=1, checkin_distance_m=33),
            appt(2, 2, "purchase", 1, "2026-09-22T16:15", 50, "completed", (165, 0, 12, 0, 0),
                 checked_in_at="2026-09-22T16:11:00-07:00", checked_out_at="2026-09-22T17:02:00-07:00"),
            appt(3, 2, "reverse", 2, "2026-09-24T12:00", 90, "completed", (185, 0, 0, 0, 0)),
            appt(4, 1, "refinance", 1, "2026-09-25T19:20", 45, "no_show", (140, 15, 38, 64, 0),
                 client_order_ref="CL-317", outcome="borrower_no_show", shift_ext_id=4404,
                 checked_in_at="2026-09-25T19:14:15-07:00", checked_out_at="2026-09-25T20:01:40-07:00",
                 gps_verified=1, checkin_distance_m=27, notes="Rang twice."),
            appt(5, 3, "apostille", 2, "2026-09-26T10:10", 30, "completed", (60, 0, 27, 0, 0), invoiced=1,
                 checked_in_at="2026-09-26T10:01:00-07:00", checked_out_at="2026-09-26T10:37:30-07:00"),
        ],
        "mileage": [
            {"trip_id": 1, "appointment_id": 1, "trip_date": "2026-09-21", "miles": "17.5", "rate": "0.70", "deduction": "12.25"},
            {"trip_id": 2, "appointment_id": 2, "trip_date": "2026-09-22", "miles": 26, "rate": "0.70", "deduction": "18.20"},
            {"trip_id": 3, "appointment_id": 4, "trip_date": "2026-09-25", "miles": 9, "rate": "0.70", "deduction": "6.30"},
            {"trip_id": 4, "appointment_id": 5, "trip_date": "2026-09-26", "miles": 40, "rate": "0.70", "deduction": "28.00"},
        ],
        "invoices": [
            {"invoice_id": 1, "client_id": 3, "invoice_number": "INV-2026-0001", "invoice_date": "2026-09-26",
             "due_date": "2026-09-26", "total_amount": 87, "paid": 1, "paid_date": "2026-09-26"},
        ],
    }


@pytest.fixture(scope="session")
def example(spark, tmp_path_factory):
    """The example, stored and read back the way a deployment would."""
    from apptledger.sources.tables import load_tables, save_tables

    path = str(tmp_path_factory.mktemp("example") / "tables")
    settings = {"timezone_offset": "-07:00", "default_notary_id": "1", "business_name": "Example Signings"}
    save_tables(make_tables(spark, settings, **example_rows()), path)
    return load_tables(spark, path)
