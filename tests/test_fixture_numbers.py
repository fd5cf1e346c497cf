"""Known totals of the test tables, from FIXTURES.md."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apptledger.operators import scheduling
from apptledger.plans import reports, views
from apptledger.sources import starschema as star
from conftest import AS_OF, TESTDATA


@pytest.fixture(scope="module")
def tables(spark):
    return star.tables(spark, str(TESTDATA))


def test_appointments(tables):
    rows = {r.status: r for r in views.billable_appointments(tables).groupBy("status").agg(
        F.count("*").alias("n"), F.sum("billable_total").alias("total")).collect()}
    assert {s: r.n for s, r in rows.items()} == {
        "cancelled": 241, "completed": 493, "confirmed": 161, "no_show": 252, "requested": 186, "rescheduled": 167}
    assert (rows["completed"].total, rows["no_show"].total, rows["cancelled"].total) == (116805, 25350, 1890)
    assert tables.appointments.agg(F.sum("duration_minutes")).first()[0] == 99480


def test_views(tables):
    assert views.appointments_today(tables, AS_OF).count() == 3
    assert views.appointments_upcoming(tables, AS_OF).count() == 31
    drops = views.drops_due(tables, AS_OF)
    assert (drops.count(), drops.where("overdue = 1").count()) == (60, 51)
    owed = views.receivables_by_client(tables).agg(F.count("*"), F.sum("total_billable")).first()
    assert tuple(owed) == (146, Decimal("110765.00"))
    due = views.payouts_due(tables).agg(F.count("*"), F.sum("amount"), F.sum("needs_amount")).first()
    assert tuple(due) == (266, Decimal("20514.00"), 78)
    assert views.payouts_missing(tables).count() == 191


def test_aging(tables):
    buckets = {r.aging_bucket: r.invoices for r in reports.aging_summary(tables, AS_OF).collect()}
    assert buckets == {"current": 227, "30": 224, "60": 269, "90+": 280}
    assert views.invoices_outstanding(tables, AS_OF).where("due_date IS NULL AND aging_bucket = '90+'").count() == 20


def test_colliding_pairs(tables):
    """Each pair counts once at either end."""
    counted = scheduling.schedule_conflicts(tables).agg(F.sum("conflicts")).first()[0]
    assert counted == 2 * 341


def test_no_shows(tables):
    rows = views.no_show_evidence(tables)
    seconds = F.unix_seconds("checked_out_at") - F.unix_seconds("checked_in_at")
    assert tuple(rows.agg(F.count("*"), F.sum(F.col("checked_out_at").isNull().cast("int")), F.sum(seconds)).first()) == (
        252, 30, 818069)


def test_journal_and_mileage(tables):
    assert tuple(tables.journal_index.agg(F.count("*"), F.sum("act_count")).first()) == (6000, 152257)
    totals = views.mileage_by_month(tables).agg(F.sum("miles"), F.sum("deduction"), F.sum("non_appointment_miles")).first()
    assert tuple(totals) == (152257, Decimal("104282.71"), 53170)
