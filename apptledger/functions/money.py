"""Pricing, aging and split rules. Decimal arithmetic throughout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from apptledger.functions.times import col, date_literal
from apptledger.model import MONEY


def _owed(*fees: str) -> Column:
    total = F.lit(0).cast(MONEY)
    for fee in fees:
        total = total + F.coalesce(F.col(fee), F.lit(0).cast(MONEY))
    return F.round(total, 2)


def billable_total() -> Column:
    """What the client owes for one appointment, by how it ended."""
    return (
        F.when(F.col("status") == "completed", _owed("signing_fee", "print_fee", "trip_fee", "other_fee"))
        .when(F.col("status") == "no_show", _owed("trip_fee", "no_sign_fee"))
        .when(F.col("status") == "cancelled", _owed("other_fee"))
        .otherwise(F.lit(0))
        .cast(MONEY)
    )


def deduction(miles: Column | str = "miles", rate: Column | str = "rate") -> Column:
    return F.round(col(miles) * F.coalesce(col(rate), F.lit(0).cast("decimal(9,4)")), 2).cast(MONEY)


def payout_amount(billable: Column | str = "billable_total") -> Column:
    """The worker's split; NULL when the roster row has none."""
    share = col(billable) * F.col("payout_value") * F.lit("0.01").cast("decimal(3,2)")
    return (
        F.when(F.col("payout_type") == "flat", F.col("payout_value"))
        .when(F.col("payout_type") == "percent", F.round(share, 2))
        .cast(MONEY)
    )


def due_date(invoice_date: Column | str, terms_days: Column | str) -> Column:
    return F.date_add(col(invoice_date), col(terms_days))


def days_past_due(as_of: dt.date, due: Column | str = "due_date") -> Column:
    return F.date_diff(date_literal(as_of), col(due))


def aging_bucket(as_of: dt.date, due: Column | str = "due_date") -> Column:
    """An unknown due date lands in the last bucket: no comparison holds for it."""
    late = days_past_due(as_of, due)
    return F.when(late <= 0, "current").when(late <= 30, "30").when(late <= 60, "60").otherwise("90+")


def aging_rank(bucket: Column | str = "aging_bucket") -> Column:
    """Worst first."""
    bucket = col(bucket)
    return F.when(bucket == "90+", 1).when(bucket == "60", 2).when(bucket == "30", 3).otherwise(4)
