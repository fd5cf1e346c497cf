"""Physical plans: what is pushed down, pruned, broadcast, and kept off Python."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from apptledger.operators import billing, privacy
from apptledger.plans import catalog, views
from apptledger.sources.tables import load_tables, save_tables
from apptledger.sources import starschema as star
from conftest import AS_OF, TESTDATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filters_prune_partitions(stored):
    text = plan(views.appointments_today(stored, AS_OF))
    (line,) = [x for x in text.splitlines() if "PartitionFilters" in x and "appointment_date" in x]
    assert "PartitionFilters: [isnotnull(appointment_date" in line
    assert "In(status, [confirmed,requested])" in line


def test_filters_reach_the_scan(stored):
    assert "EqualTo(paid,0)" in plan(views.invoices_outstanding(stored, AS_OF))
    assert "EqualTo(status,completed)" in plan(views.drops_due(stored, AS_OF))
    assert "EqualTo(invoiced,0)" in plan(views.receivables_by_client(stored))
    assert "EqualTo(is_owner,0)" in plan(views.payouts_due(stored))


def test_only_needed_columns_are_read(stored):
    text = plan(views.receivables_by_client(stored))
    schemas = [x.split("ReadSchema: ")[1] for x in text.splitlines() if "ReadSchema" in x]
    assert not any("signer_name" in s or "access_notes" in s for s in schemas)
    (mileage,) = [x.split("ReadSchema: ")[1] for x in plan(views.mileage_by_month(stored)).splitlines() if "ReadSchema" in x]
    assert "purpose" not in mileage and "miles" in mileage


def test_small_lookups_are_broadcast(stored):
    text = plan(views.appointments_upcoming(stored, AS_OF))
    assert text.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in text


def test_aggregates_combine_before_the_shuffle(stored):
    text = plan(views.receivables_by_client(stored))
    assert "partial_sum" in text
    assert "Window" not in plan(views.payouts_due(stored))


QUIET = [n for n in catalog.QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", QUIET)
def test_no_python_and_no_cross_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, str(TESTDATA)))
    for operator in ["Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow"]:
        assert operator not in text, operator


def test_outbound_rows_carry_nothing_private(stored):
    queue = privacy.dispatch_queue(stored, AS_OF)
    assert not set(queue.columns) & set(privacy.PRIVATE_COLUMNS)
    assert privacy.find_leaks(privacy.outbound_texts(stored), stored).count() == 0


def test_saved_tables_read_back(stored, spark):
    fresh = star.tables(spark, str(TESTDATA))
    for name in ["clients", "payouts", "invoices"]:
        assert getattr(stored, name).exceptAll(getattr(fresh, name)).count() == 0
    days = stored.appointments.select("appointment_date").distinct().count()
    assert days == fresh.appointments.select(F.to_date("scheduled_start")).distinct().count()


def test_moved_appointments_are_found_under_their_new_date(stored):
    """The stored date column must not hide a row that changed its start."""
    from apptledger.operators import scheduling

    (one,) = views.appointments_today(stored, AS_OF).select("appointment_id").limit(1).collect()
    moves = stored.appointments.where(F.col("appointment_id") == one.appointment_id).select(
        "appointment_id", F.lit("2026-10-20 09:00:00").cast("timestamp_ntz").alias("scheduled_start"))
    after = scheduling.reschedule_same_day(stored, moves, AS_OF)
    assert "appointment_date" not in after.appointments.columns
    day = dt.date(2026, 10, 20)
    found = views.appointments_between(after, day, day).where(F.col("appointment_id") == one.appointment_id)
    assert found.count() == 1


def test_invoice_lines_group_is_bounded(stored):
    text = plan(billing.invoice_documents(stored, billing.invoice_run(stored, AS_OF)))
    # Lines are ranked by ranges of ids and gathered by part, never by client alone.
    assert "_range#" in text and "hashpartitioning(client_id" in text
    assert [x for x in text.splitlines() if "collect_list" in x and "part_no" in x]


def test_small_changes_do_not_shuffle_the_table(stored):
    """Also when the change set was derived, so that its size was not known before."""
    from apptledger.operators import scheduling

    requests = stored.appointments.join(stored.clients.where("client_type = 'lender'"), "client_id").select(
        "appointment_id", F.lit(None).cast("decimal(12,2)").alias("other_fee"))
    text = plan(scheduling.cancel(stored, requests, AS_OF).appointments)
    # Requests are reduced to one per appointment; the appointments stay where they are.
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_changing_some_days_leaves_the_others(spark, tmp_path):
    from apptledger.operators import scheduling
    from apptledger.sources.tables import days_of, replace_days, within_days

    path = str(tmp_path / "tables")
    save_tables(star.tables(spark, str(TESTDATA)), path)
    tables = load_tables(spark, path)
    total = tables.appointments.count()
    requests = tables.appointments.where("status = 'confirmed' AND appointment_date = DATE '2026-09-07'").select(
        "appointment_id", F.lit(None).cast("decimal(12,2)").alias("other_fee"))
    asked = requests.count()
    days = days_of(tables, requests)
    assert days == [dt.date(2026, 9, 7)]
    part = within_days(tables, days)
    assert "PartitionFilters: [isnotnull(appointment_date" in plan(part.appointments)
    replace_days(scheduling.cancel(part, requests, AS_OF).appointments, days, path)

    after = load_tables(spark, path).appointments
    assert after.count() == total
    assert after.where(F.col("updated_at") == F.lit(str(AS_OF)).cast("timestamp_ntz")).count() == asked > 0

    again = within_days(load_tables(spark, path), days)
    moved = again.appointments.withColumn("scheduled_start", F.lit("2026-09-20 09:00:00").cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        replace_days(moved, days, path)


def test_one_day_of_a_worker_reads_one_partition(stored):
    from apptledger.operators import lookups

    for rows in (lookups.worker_day(stored, 0, dt.date(2026, 9, 7)),
                 lookups.collisions(stored, 0, dt.datetime(2026, 9, 7, 10), 60)):
        assert "PartitionFilters: [isnotnull(appointment_date" in plan(rows)


def test_numbers_of_a_part_continue_after_all_rows(stored, spark):
    """Ids and holders come from every day, also when only some are read."""
    from apptledger.operators import admission, upkeep
    from apptledger.sources.tables import within_days

    highest = stored.appointments.agg(F.max("appointment_id")).first()[0]
    part = within_days(stored, [dt.date(2026, 9, 7)])
    new = spark.sql("SELECT 1L AS request_id, 1L AS client_id, 1L AS place_id, TIMESTAMP_NTZ '2026-09-07 09:00:00' AS scheduled_start")
    admitted = admission.admit_appointments(part, new, AS_OF).appointments
    assert admitted.agg(F.max("appointment_id")).first()[0] == highest + 1
    kept, blocked = upkeep.delete_places(part, stored.places.select("place_id"))
    assert blocked.count() == stored.appointments.select("place_id").distinct().count()


def test_equal_starts_know_each_other(spark):
    from conftest import make_tables
    from apptledger.operators import scheduling

    rows = [{"appointment_id": i, "appointment_no": str(i), "client_id": 1, "place_id": 1, "status": "confirmed", "notary_id": 1,
             "duration_minutes": 30, "scheduled_start": "2026-09-30T10:00"} for i in (4, 7, 9)]
    found = scheduling.schedule_conflicts(make_tables(spark, appointments=rows), 0).collect()
    assert {r.appointment_id: (r.conflicts, r.same_start) for r in found} == {4: (2, 9), 7: (2, 4), 9: (2, 4)}


def test_quality_rules_read_each_table_once(stored, monkeypatch):
    """One pass over each table makes the facts; the rules exchange only those."""
    from apptledger.operators import quality

    seen = []
    monkeypatch.setattr(quality, "materialized", lambda df, label: seen.append((label, df)) or df)
    rules = [*quality.enum_rules(), *quality.range_rules(), *quality.required_rules(), *quality.single_day_rules()]
    text = plan(quality.facts(stored, rules, quality.UNIQUE, quality.REFERENCES))
    assert text.count("FileScan parquet") == 9 and "Exchange" not in text
    (_, known), = seen
    quality.judged(known)
    wrong = plan(dict(seen)["wrong"])
    assert wrong.count("Exchange hashpartitioning") == 1 and "partial_sum" in wrong


def test_times_of_sql_functions_reach_the_scan(stored, spark):
    views.register_functions(spark, stored)
    text = plan(spark.sql("SELECT * FROM drops_due(TIMESTAMP_NTZ '2026-09-30 14:36:00')"))
    (scan,) = [x for x in text.splitlines() if "drop_deadline" in x and "PushedFilters" in x]
    assert "EqualTo(status,completed)" in scan and "LessThanOrEqual(drop_deadline," in scan


def test_trips_and_invoices_are_stored_by_date(stored, spark):
    """A period reads its own days, and a snapshot stored without them reads as before."""
    from apptledger.operators import lookups
    from apptledger.plans import reports

    for rows in (lookups.trips_between(stored, dt.date(1995, 1, 1), dt.date(1995, 1, 31)), reports.month_total(stored, "1995-01")):
        (scan,) = [x for x in plan(rows).splitlines() if "PartitionFilters" in x and "trip_date" in x]
        assert "PartitionFilters: [isnotnull(trip_date" in scan
    fresh = star.tables(spark, str(TESTDATA))
    assert stored.mileage.columns == fresh.mileage.columns and stored.invoices.columns == fresh.invoices.columns
    assert stored.mileage.exceptAll(fresh.mileage).count() == 0 and stored.mileage.count() == fresh.mileage.count()
    june = stored.invoices.where("invoice_date BETWEEN DATE '2026-06-01' AND DATE '2026-06-30'")
    assert "PartitionFilters: [isnotnull(invoice_date" in plan(june) and june.count() > 0
