"""The example week, priced, invoiced and aged by the stated rules."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apptledger.operators import billing, presence
from apptledger.plans import reports, views
from apptledger.sources import documents
from conftest import AS_OF, by_key


def test_billable_totals(example):
    rows = by_key(views.billable_appointments(example), "appointment_id")
    assert {k: r.billable_total for k, r in rows.items()} == {
        1: Decimal("163.00"), 2: Decimal("177.00"), 3: Decimal("185.00"), 4: Decimal("102.00"), 5: Decimal("87.00"),
    }
    assert rows[1].appointment_date == dt.date(2026, 9, 21)


def test_receivables(example):
    rows = by_key(views.receivables_by_client(example), "client_id")
    assert set(rows) == {1, 2}
    first = rows[1]
    assert (first.total_billable, first.appointment_count, first.completed_count, first.no_show_count) == (265, 2, 1, 1)
    assert (first.first_date, first.last_date) == (dt.date(2026, 9, 21), dt.date(2026, 9, 25))
    assert rows[2].total_billable == 362


def test_no_show_evidence(example):
    (row,) = views.no_show_evidence(example).collect()
    assert row.minutes_on_site == 47
    assert row.start_iso == "2026-09-25T19:20:00-07:00"
    assert row.street_address == "340 Birch Ln, Fairmont, OR 97301"
    assert (row.trip_fee, row.no_sign_fee, row.billable_total) == (38, 64, 102)


def test_mileage(example):
    (row,) = views.mileage_by_month(example).collect()
    assert (row.month, row.trips, row.miles, row.deduction, row.non_appointment_miles) == (
        "2026-09", 4, Decimal("92.5"), Decimal("64.75"), 0)
    (total,) = reports.month_total(example, "2026-09").collect()
    assert total.average_rate == Decimal("0.7000")
    assert reports.month_total(example, "2026-12").count() == 0


def test_invoice_run_and_aging(example):
    after = billing.apply_invoice_run(example, AS_OF)
    new = by_key(after.invoices.where("paid = 0"), "client_id")
    assert new[1].total_amount == 265 and new[1].due_date == dt.date(2026, 10, 21)
    assert new[2].total_amount == 362 and new[2].due_date == dt.date(2026, 10, 14)
    assert {r.invoice_number for r in new.values()} == {"INV-2026-0002", "INV-2026-0003"}
    assert new[1].line_items.startswith('[{"appointment_no":"A-2026-0001","date":"2026-09-21","type":"heloc"')

    outstanding = by_key(views.invoices_outstanding(after, AS_OF), "client_id")
    assert {(r.days_past_due, r.aging_bucket, r.overdue) for r in outstanding.values()} == {
        (-21, "current", 0), (-14, "current", 0)}
    (summary,) = reports.outstanding_summary(after, AS_OF).collect()
    assert (summary.outstanding, summary.overdue) == (627, 0)

    assert views.receivables_by_client(after).count() == 0
    again = billing.explode_line_items(after.invoices.where("client_id = 1").select("invoice_id", "line_items"))
    assert {(r.order_ref, r.billable) for r in again.collect()} == {("CL-301", 163.0), ("CL-317", 102.0)}


def test_invoice_for_one_client(example, spark):
    only = example.clients.where("client_id = 2")
    after = billing.apply_invoice_run(example, AS_OF, only)
    assert [r.client_id for r in after.invoices.where("paid = 0").collect()] == [2]
    assert [r.client_id for r in views.receivables_by_client(after).collect()] == [1]


def test_invoice_text(example):
    texts = documents.render_invoices(example, billing.invoice_run(example, AS_OF).where("client_id = 1"))
    (row,) = texts.collect()
    assert row.text.splitlines() == [
        "Example Signings",
        f"Invoice {row.invoice_number}",
        "To: Cedar Lane Closings (accounts@cedarlane.example)",
        "Date: 2026-09-30    Due: 2026-10-21 (net 21)",
        "",
        "  A-2026-0001  2026-09-21  heloc, order CL-301  signing $110.00 + print $15.00 + trip $38.00  $163.00",
        "  A-2026-0004  2026-09-25  refinance, order CL-317  trip $38.00 + no-sign $64.00 "
        "(Trip / no-sign fee - signer did not appear; GPS-verified arrival 19:14)  $102.00",
        "",
        "Total due: $265.00",
    ]


def test_invoices_carry_no_private_data(example):
    secret = example.replace(appointments=example.appointments.withColumns({
        "signer_name": F.lit("Pat Doe"), "signer_phone": F.lit("509-555-0111"), "access_notes": F.lit("ring 2B")}))
    for row in documents.render_invoices(secret, billing.invoice_run(secret, AS_OF)).collect():
        for private in ["Pat Doe", "555-0111", "ring 2B", "Side door", "Birch Ln", "Harbor Way"]:
            assert private not in row.text


def test_no_show_note(example):
    (row,) = documents.render_no_show_notes(example).collect()
    assert "Arrived 19:14, GPS-verified 27 m from the address; on site 47 minutes, left 20:01." in row.text
    assert row.text.startswith("Order CL-317: no signing at the appointment of 2026-09-25 19:20.")


def test_punctuality(example):
    rows = by_key(presence.punctuality(example, AS_OF), "appointment_id")
    assert rows[1].minutes_early == 9 and rows[4].minutes_early == 6
    assert rows[3].presence == "not_checked_in" and rows[1].presence == "done"


def test_checkin_policy(example):
    allowed = presence.checkin_eligibility(example, presence.CheckinPolicy(radius_m=150, slack_min=7))
    assert {r.appointment_id for r in allowed.where("allowed").collect()} == {4}
    assert presence.CheckinPolicy(radius_m=50).effective_radius_m == 91
    assert presence.CheckinPolicy(radius_m=95).effective_radius_m == 95
    remote = presence.checkin_eligibility(example, presence.CheckinPolicy(slack_min=20, remote_checkin=True))
    assert remote.where("allowed").count() == 4


@pytest.mark.parametrize("policy", [{"radius_m": 5}, {"radius_m": 20000}, {"checkout_reminder_min": 61}])
def test_policy_ranges(policy):
    with pytest.raises(ValueError):
        presence.CheckinPolicy(**policy)


def test_reminders(example):
    after = billing.apply_invoice_run(example, AS_OF)
    assert documents.render_reminders(after, AS_OF).count() == 0
    late = by_key(documents.render_reminders(after, AS_OF + dt.timedelta(days=18)), "client_id")
    assert set(late) == {2}
    assert late[2].text.endswith("to Mill Creek Settlement for $362.00 was due on 2026-10-14, 4 days ago.")
    both = by_key(documents.render_reminders(after, AS_OF + dt.timedelta(days=22)), "client_id")
    assert both[1].text.endswith("was due on 2026-10-21, 1 days ago. Orders: CL-301, CL-317.")


def test_written_texts(example, tmp_path, spark):
    path = str(tmp_path / "texts")
    documents.write_texts(documents.render_no_show_notes(example), path, "appointment_no")
    back = spark.read.text(path, wholetext=True).collect()
    assert len(back) == 1 and back[0].appointment_no == "A-2026-0004"


def test_views_readable_from_sql(example, spark):
    views.register_views(spark, example, AS_OF)
    (row,) = spark.sql("SELECT sum(total_billable) AS owed FROM receivables_by_client").collect()
    assert row.owed == 627
    ordered = views.listed("receivables_by_client", views.receivables_by_client(example)).collect()
    assert [r.client_id for r in ordered] == [2, 1]


def test_results_do_not_depend_on_session_zone(example, spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        (row,) = views.no_show_evidence(example).select("start_iso", "minutes_on_site").collect()
        early = by_key(presence.punctuality(example, AS_OF), "appointment_id")[1].minutes_early
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row.start_iso, row.minutes_on_site, early) == ("2026-09-25T19:20:00-07:00", 47, 9)


def test_totals_agree_between_run_and_receivables(example):
    owed = views.receivables_by_client(example).agg(F.sum("total_billable")).first()[0]
    billed = billing.invoice_run(example, AS_OF).agg(F.sum("total_amount")).first()[0]
    assert owed == billed


def test_views_as_functions_of_sql(example, spark):
    """Any time can be asked for, and rows and columns are those of the DataFrames."""
    views.register_functions(spark, example)
    for name, df in views.all_views(example, AS_OF).items():
        if name not in views.NEEDS_TIME:
            assert sorted(map(str, spark.sql(f"SELECT * FROM {name}()").collect())) == sorted(map(str, df.collect()))
    seen = set()
    for as_of in (AS_OF, dt.datetime(2026, 9, 21, 6), dt.datetime(2026, 11, 3, 23, 59, 59)):
        moved = example.replace(appointments=example.appointments.withColumn(
            "status", F.when(F.col("appointment_id") < 3, "confirmed").otherwise(F.col("status"))).withColumn(
            "drop_deadline", F.timestamp_add("HOUR", (F.col("appointment_id") * 5).cast("int"), F.lit(as_of - dt.timedelta(hours=12)).cast("timestamp_ntz"))))
        moved = moved.replace(invoices=moved.invoices.withColumn("paid", F.lit(0)))
        views.register_functions(spark, moved)
        for name in views.NEEDS_TIME:
            expected = views.all_views(moved, as_of)[name]
            got = spark.sql(f"SELECT * FROM {name}(TIMESTAMP_NTZ '{as_of}')")
            assert got.schema.simpleString() == expected.schema.simpleString()
            assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
            seen |= {name} if expected.count() else set()
    assert seen == views.NEEDS_TIME
