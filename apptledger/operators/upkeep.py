"""Edits of clients and settings, and deletes with their referential effects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.model import Tables
from apptledger.operators.changes import apply_changes
from apptledger.operators.joins import lookup_join
from apptledger.session import materialized

FEE_DEFAULTS = ["default_signing_fee", "default_print_fee", "default_trip_fee", "default_no_sign_fee"]


def change_client_fees(tables: Tables, fees: DataFrame, as_of: dt.datetime) -> Tables:
    """New default fees by ``client_id``. Fees on existing appointments are
    snapshots and stay."""
    delta = fees.select("client_id", *[c for c in FEE_DEFAULTS if c in fees.columns])
    return tables.replace(clients=apply_changes(
        tables.clients, delta, "client_id", as_of=as_of, keep_when_null=FEE_DEFAULTS
    ))


def deactivate_clients(tables: Tables, client_ids: DataFrame, as_of: dt.datetime) -> Tables:
    delta = client_ids.select("client_id").distinct().withColumn("is_active", F.lit(0))
    return tables.replace(clients=apply_changes(tables.clients, delta, "client_id", as_of=as_of))


def update_settings(tables: Tables, values: DataFrame) -> Tables:
    """Set ``key, value`` pairs, adding keys that are new."""
    return tables.replace(settings=apply_changes(tables.settings, values, "key", insert=True))


def _ids(rows: DataFrame, column: str) -> DataFrame:
    """The distinct ids to delete, computed once for the several tables they touch."""
    return materialized(rows.select(column).distinct(), "deleted-ids")


def _marked(rows: DataFrame, ids: DataFrame, column: str, spread_by: list[str]) -> DataFrame:
    """``rows`` with ``_gone = 1`` where ``column`` is among ``ids``."""
    gone = ids.toDF(column).withColumn("_gone", F.lit(1))
    return lookup_join(rows, gone, column, "left", spread_by=spread_by, bound=ids)


def _without(rows: DataFrame, ids: DataFrame, column: str, spread_by: list[str]) -> DataFrame:
    return _marked(rows, ids, column, spread_by).where(F.col("_gone").isNull()).select(*rows.columns)


def _cleared(rows: DataFrame, ids: DataFrame, column: str, spread_by: list[str]) -> DataFrame:
    marked = _marked(rows, ids, column, spread_by)
    return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*rows.columns)


def delete_appointments(tables: Tables, ids: DataFrame) -> Tables:
    """Removes their journal pointers and payouts; trips, replacements and invoiced lines lose the link."""
    ids = _ids(ids, "appointment_id")
    left = _without(tables.appointments, ids, "appointment_id", ["appointment_id"])
    return tables.replace(
        appointments=_cleared(left, ids, "rescheduled_from", ["appointment_id"]),
        journal_index=_without(tables.journal_index, ids, "appointment_id", ["entry_id"]),
        payouts=_without(tables.payouts, ids, "appointment_id", ["payout_id"]),
        mileage=_cleared(tables.mileage, ids, "appointment_id", ["trip_id"]),
        invoice_lines=_cleared(tables.invoice_lines, ids, "appointment_id", ["invoice_id", "line_no"]),
    )


def delete_clients(tables: Tables, ids: DataFrame) -> Tables:
    """Removes their appointments, with all that hangs on those, and invoices with their lines."""
    ids = _ids(ids, "client_id")
    doomed = _marked(tables.appointments, ids, "client_id", ["appointment_id"]).where(F.col("_gone") == 1)
    bills = _marked(tables.invoices, ids, "client_id", ["invoice_id"]).where(F.col("_gone") == 1)
    after = delete_appointments(tables, doomed)
    return after.replace(
        clients=tables.clients.join(ids, "client_id", "left_anti"),
        invoices=_without(tables.invoices, ids, "client_id", ["invoice_id"]),
        invoice_lines=_without(after.invoice_lines, _ids(bills, "invoice_id"), "invoice_id", ["invoice_id", "line_no"]),
    )


def delete_notaries(tables: Tables, ids: DataFrame) -> Tables:
    """Removes their payouts; their appointments lose the worker."""
    ids = _ids(ids, "notary_id")
    return tables.replace(
        notaries=tables.notaries.join(ids, "notary_id", "left_anti"),
        payouts=_without(tables.payouts, ids, "notary_id", ["payout_id"]),
        appointments=_cleared(tables.appointments, ids, "notary_id", ["appointment_id"]),
    )


def delete_places(tables: Tables, ids: DataFrame) -> tuple[Tables, DataFrame]:
    """Deletes the places nothing refers to; returns the others, which stay, with
    the number of appointments that hold them."""
    asked = ids.select("place_id").distinct()
    holders = tables.every_appointment.groupBy("place_id").agg(F.count(F.lit(1)).alias("appointments"))
    blocked = asked.join(holders, "place_id")
    free = asked.join(holders, "place_id", "left_anti")
    return tables.replace(places=tables.places.join(free, "place_id", "left_anti")), blocked
