"""Results do not depend on how rows are spread, and hot keys are split."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from apptledger.model import conform
from apptledger.operators import billing, quality, scheduling, upkeep
from apptledger.operators.changes import latest_per_key
from apptledger.operators.joins import BROADCAST_LIMIT_CONF, lookup_join, spread_join
from apptledger.operators.numbering import assign_ids
from apptledger.plans import views
from apptledger.sources import documents as text_documents
from apptledger.sources import starschema as star
from conftest import AS_OF, TESTDATA, example_rows, make_tables


def same_rows(left, right):
    assert left.columns == right.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.fixture()
def skewed(spark):
    """A third of all rows on one key, a tenth without a key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id") % 50)
    return spark.range(3000).select("id", key.cast("bigint").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, skewed, how):
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    expected = skewed.join(lookup, "k", how).select("k", "id", "v")
    same_rows(spread_join(skewed, lookup, ["k"], how, spread_by=["id"]).select("k", "id", "v"), expected)


def test_hot_key_reaches_several_partitions(spark, skewed):
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(skewed, lookup, ["k"], "left", spread_by=["id"]).withColumn("p", F.spark_partition_id())
        hot = joined.where("k = 7").groupBy("p").count().collect()
        missing = joined.where("k IS NULL").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(hot) >= 2 and len(missing) >= 2
    assert sum(r["count"] for r in hot) == skewed.where("k = 7").count()


def test_small_lookups_broadcast_and_large_do_not(spark, skewed):
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    before = spark.conf.get(BROADCAST_LIMIT_CONF)
    small = lookup_join(skewed, lookup, "k", spread_by=["id"])
    assert "_salt" not in small._jdf.queryExecution().toString()
    try:
        spark.conf.set(BROADCAST_LIMIT_CONF, "1")
        large = lookup_join(skewed, lookup, "k", spread_by=["id"])
    finally:
        spark.conf.set(BROADCAST_LIMIT_CONF, before)
    assert "_salt" in large._jdf.queryExecution().toString()


def test_views_are_the_same_with_shuffled_joins(spark, stored, shuffled_joins):
    """Every view with its lookups shuffled, against the same with them broadcast."""
    shuffled = {name: sorted(map(str, view.collect())) for name, view in views.all_views(stored, AS_OF).items()}
    spark.conf.set(BROADCAST_LIMIT_CONF, str(2**63 - 1))
    for name, view in views.all_views(stored, AS_OF).items():
        assert sorted(map(str, view.collect())) == shuffled[name], name
        assert shuffled[name], name


def test_ids_are_dense_unique_and_repeatable(spark):
    rows = spark.range(5000).select((F.col("id") * 7919).alias("key"))
    first = assign_ids(rows, "key", "n", 100)
    ids = sorted(r.n for r in first.collect())
    assert ids == list(range(101, 5101))
    same_rows(first.orderBy("key"), assign_ids(rows.repartition(13), "key", "n", 100).orderBy("key"))


def test_latest_per_key_with_many_copies(spark):
    rows = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.col("id") % 2).alias("v"))
    assert latest_per_key(rows, ["k"], ["at"]).collect() == [(1, 1999, 1)]


def brute_force_conflicts(rows, pad):
    """Every pair compared, for small inputs only."""
    out = {}
    for a in rows:
        hits = [
            b for b in rows
            if b["id"] != a["id"] and b["worker"] == a["worker"] and b["day"] == a["day"]
            and b["start"] < a["start"] + a["minutes"] + pad and a["start"] < b["start"] + b["minutes"] + pad
        ]
        if hits:
            before = [(b["start"] + b["minutes"], b["id"]) for b in hits if b["start"] < a["start"]]
            after = [(b["start"], b["id"]) for b in hits if b["start"] > a["start"]]
            out[a["id"]] = (len(hits), max(before)[1] if before else None, min(after)[1] if after else None)
    return out


@pytest.mark.parametrize(("seed", "pad", "slots"), [(1, 30, 60), (2, 0, 6), (3, 45, 90)])
def test_conflicts_against_brute_force(spark, seed, pad, slots):
    rng = random.Random(seed)
    rows = [
        {"id": i, "worker": rng.choice([1, 1, 1, 2, 3]), "day": rng.choice([1, 1, 2]),
         "start": 480 + 5 * rng.randrange(slots), "minutes": rng.choice([15, 30, 60, 90])}
        for i in range(150)
    ]
    appointments = [
        {"appointment_id": r["id"], "appointment_no": str(r["id"]), "client_id": 1, "place_id": 1, "status": "confirmed",
         "notary_id": r["worker"], "duration_minutes": r["minutes"],
         "scheduled_start": f"2026-09-0{r['day']}T{r['start'] // 60:02d}:{r['start'] % 60:02d}"}
        for r in rows
    ]
    appointments.append({**appointments[0], "appointment_id": 900, "notary_id": None})
    appointments.append({**appointments[0], "appointment_id": 901, "status": "cancelled"})
    got = scheduling.schedule_conflicts(make_tables(spark, appointments=appointments), pad).collect()
    assert {r.appointment_id: (r.conflicts, r.blocked_by, r.runs_into) for r in got} == brute_force_conflicts(rows, pad)


def test_touching_at_the_buffer_is_no_conflict(spark):
    rows = [
        {"appointment_id": i, "client_id": 1, "place_id": 1, "status": "confirmed", "notary_id": 1,
         "duration_minutes": 60, "scheduled_start": start}
        for i, start in enumerate(["2026-09-01T10:00", "2026-09-01T11:30", "2026-09-01T12:59", "2026-09-01T23:30",
                                   "2026-09-02T00:10"])
    ]
    got = scheduling.schedule_conflicts(make_tables(spark, appointments=rows)).collect()
    assert {r.appointment_id for r in got} == {1, 2}


def test_chains(spark):
    previous = {2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 10: 9, 11: 9, 20: 21, 21: 20, 30: 999}
    rows = [
        {"appointment_id": i, "client_id": 1, "place_id": 1, "status": "confirmed", "rescheduled_from": previous.get(i)}
        for i in [*range(1, 12), 20, 21, 30]
    ]
    appointments = make_tables(spark, appointments=rows).appointments
    got = {r.appointment_id: (r.root_id, r.hops) for r in scheduling.reschedule_chain(appointments).collect()}
    assert got == {
        **{i: (1, i - 1) for i in range(2, 9)}, 10: (9, 1), 11: (9, 1), 20: (None, None), 21: (None, None), 30: (999, 1)}


def test_long_invoices_split_without_losing_lines(spark, monkeypatch):
    """A client with a third of all work, against a small document limit."""
    monkeypatch.setattr(billing, "LINES_PER_DOCUMENT", 8)
    rows = example_rows()
    rows["appointments"] = [
        {"appointment_id": i, "appointment_no": f"A-{i}", "client_id": 1 if i % 3 else 2, "place_id": 1,
         "signing_type": "seller", "status": "completed", "signing_fee": 10, "invoiced": 0,
         "scheduled_start": "2026-09-01T10:00"}
        for i in range(1, 61)
    ] + [{"appointment_id": 100, "appointment_no": "A-100", "client_id": 3, "place_id": 1, "signing_type": "seller",
          "status": "completed", "signing_fee": 10, "invoiced": 0, "scheduled_start": "2026-09-01T10:00"}]
    tables = make_tables(spark, **rows)
    headers = billing.invoice_run(tables, AS_OF)
    documents = billing.invoice_documents(tables, headers)
    assert documents.agg(F.max("lines_in_part")).first()[0] <= 8
    # Parts are full before the next begins.
    sizes = {(r.invoice_number, r.part_no): r.lines_in_part for r in documents.collect()}
    assert sorted(sizes.values()) == sorted([8] * 5 + [8, 8, 4] + [1])
    lines = billing.explode_line_items(documents)
    assert lines.count() == 61 and lines.select("appointment_no").distinct().count() == 61
    total = lines.groupBy("invoice_id").agg(F.sum("billable").alias("t")).collect()
    assert sorted(r.t for r in total) == [10.0, 200.0, 400.0]


def test_ids_far_apart_fill_parts(spark, monkeypatch):
    """Ids a hundred thousand apart make no part of one line, and every order reaches a reminder."""
    monkeypatch.setattr(billing, "LINES_PER_DOCUMENT", 100)
    rows = example_rows()
    rows["appointments"] = [
        {"appointment_id": i * 100_000, "appointment_no": f"A-{i}", "client_id": 1, "place_id": 1, "signing_type": "seller",
         "status": "completed", "signing_fee": 10, "invoiced": 0, "client_order_ref": f"R{i}", "scheduled_start": "2026-09-01T10:00"}
        for i in range(1, 1051)
    ]
    rows["invoices"] = []
    tables = make_tables(spark, **rows)
    after = billing.apply_invoice_run(tables, AS_OF)
    headers = after.invoices.join(after.clients.select("client_id", "payment_terms_days"), "client_id")
    parts = billing.invoice_documents(after, headers)
    assert after.invoice_lines.count() == 1050 and after.appointments.where("invoiced = 0").count() == 0
    assert sorted(r.lines_in_part for r in parts.collect()) == [50] + [100] * 10
    texts = [r.text for r in text_documents.render_invoices(after, headers).collect()]
    assert len(texts) == 11 and sum(t.count(", order R") for t in texts) == 1050
    told = text_documents.render_reminders(after, AS_OF + dt.timedelta(days=400)).collect()
    found = [ref for r in told for ref in r.text.split("Orders: ")[1].rstrip(".").split(", ")]
    assert sorted(found) == sorted(f"R{i}" for i in range(1, 1051))


def test_no_line_of_a_large_client_is_lost(spark, tmp_path):
    """More than 10,000 lines: stored, read back, and found again after more work came in."""
    from apptledger.sources.tables import load_tables, save_tables

    rows = example_rows()
    rows["appointments"], rows["invoices"] = [], []
    tables = make_tables(spark, **rows)
    work = spark.range(1, 10_501).selectExpr(
        "id AS appointment_id", "concat('A-', id) AS appointment_no", "1 AS client_id", "1 AS place_id", "'seller' AS signing_type",
        "'completed' AS status", "10 AS signing_fee", "0 AS invoiced", "concat('R', id) AS client_order_ref",
        "timestamp_ntz'2026-09-01 10:00:00' AS scheduled_start")
    tables = tables.replace(appointments=conform(work, "appointments"))
    save_tables(billing.apply_invoice_run(tables, AS_OF), str(tmp_path / "after"))
    after = load_tables(spark, str(tmp_path / "after"))
    headers = after.invoices.join(after.clients.select("client_id", "payment_terms_days"), "client_id")
    more = after.replace(appointments=after.appointments.unionByName(
        conform(work.limit(3).selectExpr("* EXCEPT (appointment_id)", "appointment_id + 90000 AS appointment_id"), "appointments")
        .withColumn("appointment_date", F.to_date("scheduled_start"))))
    documents = billing.invoice_documents(more, headers).collect()
    assert [r.lines_in_part for r in sorted(documents, key=lambda r: r.part_no)] == [4096, 4096, 10_500 - 8192]
    texts = [r.text for r in text_documents.render_invoices(more, headers).collect()]
    assert len(texts) == 3 and sum(t.count(", order R") for t in texts) == 10_500
    told = text_documents.render_reminders(more, AS_OF + dt.timedelta(days=400)).collect()
    found = {ref for r in told for ref in r.text.split("Orders: ")[1].rstrip(".").split(", ")}
    assert found == {f"R{i}" for i in range(1, 10_501)}
    assert after.invoice_lines.agg(F.sum("billable_total")).first()[0] == headers.first().total_amount == 105_000
    gone = upkeep.delete_clients(more, more.clients.where("client_id = 1"))
    assert gone.invoice_lines.count() == 0 and gone.invoices.count() == 0


def test_lines_of_older_snapshots_come_from_their_json(example, spark, tmp_path):
    from apptledger.sources.tables import load_tables, save_tables

    after = billing.apply_invoice_run(example, AS_OF)
    path = tmp_path / "old"
    save_tables(after, str(path))
    (path / "invoice_lines").rename(tmp_path / "aside")
    old = load_tables(spark, str(path)).invoice_lines
    columns = [c for c in old.columns if c not in ("appointment_id", "gps_verified", "checked_in_at")]
    same_rows(old.select(*columns), after.invoice_lines.select(*columns))
    assert old.count() > 2


def test_views_do_not_depend_on_row_order(spark, example):
    shuffled = example.replace(appointments=example.appointments.repartition(7).orderBy(F.desc("appointment_id")))
    for name in ["receivables_by_client", "no_show_evidence", "payouts_missing"]:
        build = getattr(views, name)
        same_rows(build(shuffled), build(example))


def test_buckets_add_up(spark):
    from apptledger.plans import reports

    tables = star.tables(spark, str(TESTDATA))
    buckets = reports.aging_summary(tables, AS_OF).agg(F.sum("amount")).first()[0]
    assert buckets == reports.outstanding_summary(tables, AS_OF).first().outstanding
    missing = views.payouts_missing(tables).join(tables.payouts, "appointment_id")
    assert missing.count() == 0


def test_clean_tables_have_no_violations(spark, example):
    assert quality.all_violations(example).collect() == []
