"""Subcontractor splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptledger.functions import money, times
from apptledger.model import Tables, conform
from apptledger.operators.changes import apply_changes
from apptledger.operators.joins import lookup_join
from apptledger.operators.numbering import assign_ids
from apptledger.plans.views import payouts_missing, priced
from apptledger.session import materialized


def fill_payout_amounts(payouts: DataFrame, tables: Tables) -> DataFrame:
    """Compute the amounts left open; given amounts stay."""
    split = tables.notaries.select("notary_id", "payout_type", "payout_value")
    work = priced(tables.appointments).select("appointment_id", "billable_total")
    rows = lookup_join(payouts, split, "notary_id", "left", spread_by=["appointment_id"])
    rows = rows.join(work, "appointment_id", "left")
    return rows.withColumn("amount", F.coalesce("amount", money.payout_amount())).select(*payouts.columns)


def create_payouts(tables: Tables, as_of: dt.datetime) -> Tables:
    """One payout for each finished appointment of a sub that has none."""
    missing = materialized(
        payouts_missing(tables).withColumn("amount", money.payout_amount()), "missing-payouts"
    )
    last = tables.payouts.agg(F.max("payout_id")).scalar()
    rows = assign_ids(missing, "appointment_id", "payout_id", last).withColumns({
        "paid": F.lit(0), "created_at": times.local_literal(as_of),
    })
    return tables.replace(payouts=tables.payouts.unionByName(conform(rows, "payouts")))


def mark_payouts_paid(tables: Tables, notary_ids: DataFrame, as_of: dt.datetime) -> Tables:
    """Settle all open payouts of these workers, then flag every appointment of
    theirs whose payout is settled, earlier ones included."""
    settled = notary_ids.select("notary_id").distinct().withColumn("_settled", F.lit(1))
    rows = lookup_join(tables.payouts, settled, "notary_id", "left", spread_by=["payout_id"], bound=tables.notaries)
    newly = (F.col("_settled") == 1) & (F.col("paid") == 0)
    rows = rows.withColumns({
        "paid_date": F.when(newly, times.date_literal(as_of.date())).otherwise(F.col("paid_date")),
        "paid": F.when(newly, 1).otherwise(F.col("paid")),
    })
    done = rows.where((F.col("_settled") == 1) & (F.col("paid") == 1)).select(
        "appointment_id", F.lit(1).alias("paid_out")
    )
    return tables.replace(
        payouts=rows.select(*tables.payouts.columns),
        appointments=apply_changes(tables.appointments, done, "appointment_id", as_of=as_of),
    )
