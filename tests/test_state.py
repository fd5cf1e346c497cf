"""State transforms: what changes, what stays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from apptledger.operators import changes, completion, places, scheduling, upkeep
from apptledger.plans import views
from apptledger.sources import feeds
from conftest import AS_OF, by_key, example_rows, frame, make_tables


def example_tables(spark, **more):
    return make_tables(spark, {"timezone_offset": "-07:00", "default_notary_id": "1"}, **{**example_rows(), **more})


def ids(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} bigint")


def test_apply_changes_is_idempotent_and_inserts(spark):
    base = spark.sql("SELECT * FROM VALUES (1L, 'a', 1), (2L, 'b', 2) AS t(id, x, y)")
    delta = spark.sql("SELECT * FROM VALUES (2L, CAST(NULL AS STRING)), (3L, 'c') AS t(id, x)")
    once = changes.apply_changes(base, delta, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, None, 2)]
    twice = changes.apply_changes(once, delta, "id")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    kept = changes.apply_changes(base, delta, "id", keep_when_null=["x"], insert=True)
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]


def test_insert_or_ignore(spark):
    target = spark.sql("SELECT * FROM VALUES ('a', '1') AS t(key, value)")
    new = spark.sql("SELECT * FROM VALUES ('a', '9'), ('b', '2'), ('b', '2') AS t(key, value)")
    assert sorted(map(tuple, changes.insert_or_ignore(target, new, ["key"]).collect())) == [("a", "1"), ("b", "2")]


def test_touching_an_appointment_moves_updated_at(spark):
    tables = example_tables(spark)
    moved = scheduling.reschedule_same_day(
        tables, frame(spark, [{"appointment_id": 3, "scheduled_start": "2026-09-24T15:30"}])
        .select(F.col("appointment_id").cast("bigint"), F.col("scheduled_start").cast("timestamp_ntz")), AS_OF)
    rows = by_key(moved.appointments, "appointment_id")
    assert rows[3].scheduled_start == dt.datetime(2026, 9, 24, 15, 30) and rows[3].updated_at == AS_OF
    assert rows[3].appointment_no == "A-2026-0003" and rows[1].updated_at is None


def test_reschedule_to_another_day(spark):
    tables = example_tables(spark)
    moves = spark.sql(
        "SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2026-10-01 09:00:00', CAST(NULL AS DECIMAL(12,2))), "
        "(2L, TIMESTAMP_NTZ '2026-10-02 09:00:00', 40.00BD) AS t(appointment_id, new_start, late_fee)")
    after = scheduling.reschedule_new_day(tables, moves, AS_OF)
    rows = by_key(views.billable_appointments(after), "appointment_id")
    assert (rows[1].status, rows[1].billable_total) == ("rescheduled", 0)
    assert (rows[2].status, rows[2].billable_total) == ("cancelled", 40)
    new = by_key(after.appointments.where("rescheduled_from IS NOT NULL"), "rescheduled_from")
    assert (new[1].status, new[1].signing_fee, new[1].trip_fee, new[1].client_order_ref) == ("confirmed", 110, 38, "CL-301")
    assert new[2].other_fee == 0 and new[1].shift_ext_id is None and new[1].checked_in_at is None
    assert {r.appointment_id for r in new.values()} == {6, 7}
    assert new[1].appointment_no == f"A-2026-{new[1].appointment_id:04d}"


def test_cancel_and_swap(spark):
    tables = example_tables(spark)
    requests = spark.sql("SELECT * FROM VALUES (1L, 35.00BD), (2L, NULL) AS t(appointment_id, other_fee)")
    rows = by_key(views.billable_appointments(scheduling.cancel(tables, requests, AS_OF)), "appointment_id")
    assert (rows[1].billable_total, rows[2].billable_total) == (35, 0)

    swap = spark.sql("SELECT 4L AS appointment_id, 2L AS notary_id")
    after = by_key(scheduling.swap_worker(tables, swap, AS_OF).appointments, "appointment_id")[4]
    assert after.notary_id == 2 and after.shift_ext_id is None
    (call,) = scheduling.swap_calls(swap, tables.appointments).collect()
    assert (call.cancel_key, call.shift_key) == ("cancel-shift-4404", "shift-appt-4-2")


SUBMISSION = """{"submissions":[
 {"submission_id":%d,"worker_id":511,"event_id":%d,"submitted_at":"2026-09-21 10:05:12",
  "data":{"outcome":"%s","docs_notarized":8,"id_types":["state_driver_license"],"scanbacks":"%s",
          "tracking_no":%s,"issues":"issue","no_sign_details":"waited"},
  "media":[{"field":"%s","cdn_url":"https://cdn.example/r.jpg"}]}]}"""


def test_completions(spark):
    appointments = [
        {**a, "status": "confirmed", "event_ext_id": 6300 + a["appointment_id"],
         "shift_ext_id": 4400 + a["appointment_id"], "checked_in_at": None, "checked_out_at": None, "notes": "n. "}
        for a in example_rows()["appointments"]
    ]
    tables = example_tables(spark, appointments=appointments)
    bodies = [
        SUBMISSION % (1, 6301, "completed", "sent", '"8840"', "other"),
        SUBMISSION % (2, 6302, "partial___some_docs_signed", "not_required", "null", "drop_receipt"),
        SUBMISSION % (3, 6303, "rescheduled_on_site", "pending", "null", "other"),
        SUBMISSION % (4, 6304, "borrower_no_show", "pending", '"55"', "other"),
        SUBMISSION % (5, 6399, "completed", "sent", "null", "other"),
        SUBMISSION % (6, 6305, "something new", "sent", "null", "other"),
        "{broken",
    ]
    raw = spark.createDataFrame([(b.replace("\n", ""),) for b in bodies], "body string")
    records, rejected = feeds.read_submissions(raw)
    assert [r.broken for r in rejected.collect()] == ["{broken"]
    assert "id_types" not in records.columns

    rows = by_key(completion.apply_completions(tables, records, AS_OF).appointments, "appointment_id")
    at = dt.datetime(2026, 9, 21, 10, 5, 12)
    one, two, three, four, five = (rows[i] for i in range(1, 6))
    assert (one.status, one.outcome, one.docs_notarized, one.dropped_at, one.scanbacks_sent_at, one.notes) == (
        "completed", "completed", 8, at, at, "n. issue")
    assert (two.status, two.dropped_at, two.scanbacks_required, two.scanbacks_sent_at) == ("completed", at, 0, None)
    assert (three.status, three.dropped_at, three.scanbacks_required) == ("rescheduled", None, 1)
    assert (four.status, four.dropped_at, four.tracking_no, four.notes, four.trip_fee) == (
        "no_show", None, None, "n. waited", 38)
    assert five.status == "confirmed" and five.updated_at is None

    shifts = spark.createDataFrame([
        ('{"shift_id":4401,"worker_id":1,"status":"checked_out","actual_in":"2026-09-21T08:20:40-07:00",'
         '"actual_out":"2026-09-21T09:40:05-07:00","punches":[{"type":"in","gps_verified":true,'
         '"distance_from_site_m":33},{"type":"out","gps_verified":true,"distance_from_site_m":20}]}',),
        ('{"shift_id":4402,"worker_id":1,"status":"missed","punches":[]}',),
    ], "body string")
    stamps, _ = feeds.read_shift_status(shifts)
    rows = by_key(completion.apply_completions(tables, records, AS_OF, stamps).appointments, "appointment_id")
    assert rows[1].checkin_distance_m == 33 and rows[1].gps_verified == 1 and rows[1].status == "completed"
    assert rows[2].status == "confirmed", "nobody punched that shift"


def test_no_shows_and_drops(spark):
    tables = example_tables(spark)
    told = spark.sql("SELECT 3L AS appointment_id, 'borrower_no_show' AS outcome, CAST(NULL AS STRING) AS details")
    row = by_key(completion.apply_no_shows(tables, told, AS_OF).appointments, "appointment_id")[3]
    assert (row.status, row.notes, row.signing_fee) == ("no_show", None, 185)
    drops = spark.sql("SELECT 'A-2026-0001' AS appointment_no, TIMESTAMP_NTZ '2026-09-21 11:00:00' AS dropped_at, "
                      "'77' AS tracking_no, 'UPS' AS shipping_carrier")
    row = by_key(completion.record_drops(tables, drops, AS_OF).appointments, "appointment_id")[1]
    assert (row.tracking_no, row.shipping_carrier) == ("77", "UPS")


def test_places(spark):
    tables = example_tables(spark)
    requests = frame(spark, [
        {"request_id": 1, "address": "340  BIRCH Ln.", "city": "Fairmont", "state": "or", "zip": "97301",
         "client_name": "x", "is_repeat_site": 0},
        {"request_id": 2, "address": "9 New Rd", "city": "Salem", "state": "OR", "zip": None, "client_name": "Big Bank",
         "is_repeat_site": 1},
        {"request_id": 3, "address": "9 new rd.", "city": "SALEM", "state": "or", "zip": None, "client_name": "other",
         "is_repeat_site": 0},
    ]).withColumn("request_id", F.col("request_id").cast("bigint")).withColumn(
        "is_repeat_site", F.col("is_repeat_site").cast("int"))
    hits, misses = places.resolve_places(requests, tables.places)
    assert [r.place_id for r in hits.collect()] == [1] and misses.count() == 2
    after, matched = places.admit_places(tables, requests, AS_OF)
    assert after.places.count() == 3
    (new,) = after.places.where("place_id = 3").collect()
    assert (new.place_label, new.normalized_address) == ("Big Bank - Salem", "9 new rd salem or")
    assert {r.request_id: r.place_id for r in matched.collect()} == {1: 1, 2: 3, 3: 3}

    merged = places.merge_places(tables, spark.sql("SELECT 2L AS place_id, 1L AS survivor_id"), AS_OF)
    assert {r.place_id for r in merged.appointments.collect()} == {1}
    (left,) = merged.places.collect()
    assert (left.place_id, left.location_ext_id) == (1, 5502)


def test_deletes(spark):
    payouts = [{"payout_id": 1, "notary_id": 2, "appointment_id": 1, "paid": 0},
               {"payout_id": 2, "notary_id": 3, "appointment_id": 2, "paid": 0}]
    journal = [{"entry_id": 1, "appointment_id": 1, "journal_book": "b", "entry_no": "1", "act_type": "jurat"}]
    rows = example_rows()["appointments"]
    rows[2]["rescheduled_from"] = 1
    rows[1]["notary_id"] = 3
    tables = example_tables(spark, payouts=payouts, journal_index=journal, appointments=rows)

    after = upkeep.delete_clients(tables, ids(spark, "client_id", 1))
    assert {r.appointment_id for r in after.appointments.collect()} == {2, 3, 5}
    assert by_key(after.appointments, "appointment_id")[3].rescheduled_from is None
    assert after.journal_index.count() == 0 and [r.payout_id for r in after.payouts.collect()] == [2]
    assert {r.trip_id: r.appointment_id for r in after.mileage.collect()} == {1: None, 2: 2, 3: None, 4: 5}
    assert after.clients.count() == 2 and after.invoices.count() == 1

    after = upkeep.delete_notaries(tables, ids(spark, "notary_id", 3))
    assert by_key(after.appointments, "appointment_id")[2].notary_id is None
    assert [r.payout_id for r in after.payouts.collect()] == [1] and after.notaries.count() == 3

    kept, blocked = upkeep.delete_places(tables, ids(spark, "place_id", 1, 2))
    assert kept.places.count() == 2 and {r.place_id: r.appointments for r in blocked.collect()} == {1: 2, 2: 3}


def test_client_edits_leave_snapshots(spark):
    tables = example_tables(spark)
    fees = spark.sql("SELECT 1L AS client_id, 200.00BD AS default_signing_fee")
    after = upkeep.change_client_fees(tables, fees, AS_OF)
    assert by_key(after.clients, "client_id")[1].default_signing_fee == 200
    assert by_key(views.receivables_by_client(after), "client_id")[1].total_billable == 265
    off = upkeep.deactivate_clients(tables, ids(spark, "client_id", 2), AS_OF)
    assert by_key(off.clients, "client_id")[2].is_active == 0
    values = spark.sql("SELECT * FROM VALUES ('state', 'WA'), ('motto', 'on time') AS t(key, value)")
    settings = {r.key: r.value for r in upkeep.update_settings(tables, values).settings.collect()}
    assert settings["state"] == "WA" and settings["motto"] == "on time" and settings["timezone_offset"] == "-07:00"


def test_links(spark):
    tables = example_tables(spark)
    links = spark.sql("SELECT 1L AS appointment_id, 71L AS event_ext_id, 81L AS shift_ext_id")
    assert by_key(scheduling.link_external_ids(tables, links, AS_OF).appointments, "appointment_id")[1].shift_ext_id == 81
    spots = spark.sql("SELECT 1L AS place_id, 9L AS location_ext_id")
    assert by_key(places.link_locations(tables, spots, AS_OF).places, "place_id")[1].location_ext_id == 9


def test_a_request_sent_twice_counts_once(spark):
    """Every transform keeps one row per appointment, and the last request wins."""
    tables = example_tables(spark)
    count = tables.appointments.count()
    twice = spark.sql(
        "SELECT * FROM VALUES (1L, 35.00BD, 2), (1L, 35.00BD, 2), (1L, 99.00BD, 1), (NULL, 1.00BD, 1) "
        "AS t(appointment_id, other_fee, requested_at)")
    after = scheduling.cancel(tables, twice, AS_OF).appointments
    assert after.count() == count and by_key(after, "appointment_id")[1].other_fee == 35
    swaps = spark.sql("SELECT * FROM VALUES (1L, 2L), (1L, 3L), (1L, 3L) AS t(appointment_id, notary_id)")
    after = scheduling.swap_worker(tables, swaps, AS_OF).appointments
    assert after.count() == count and by_key(after, "appointment_id")[1].notary_id == 3
    assert scheduling.swap_calls(swaps, tables.appointments).count() == 1
    moves = spark.sql(
        "SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2026-10-01 09:00:00', 5.00BD, 1), (1L, TIMESTAMP_NTZ '2026-10-03 09:00:00', "
        "NULL, 2) AS t(appointment_id, new_start, late_fee, requested_at)")
    after = by_key(scheduling.reschedule_new_day(tables, moves, AS_OF).appointments, "appointment_id")
    assert len(after) == count + 1 and after[1].status == "rescheduled"
    assert after[6].scheduled_start == dt.datetime(2026, 10, 3, 9)
    told = spark.sql("SELECT * FROM VALUES (3L, 'a', 'x'), (3L, 'a', 'x') AS t(appointment_id, outcome, details)")
    row = by_key(completion.apply_no_shows(tables, told, AS_OF).appointments, "appointment_id")[3]
    assert row.notes == "x"
    sent = spark.sql("SELECT * FROM VALUES ('A-2026-0001', TIMESTAMP_NTZ '2026-09-21 11:00:00'), "
                     "('A-2026-0001', TIMESTAMP_NTZ '2026-09-21 12:00:00') AS t(appointment_no, scanbacks_sent_at)")
    after = completion.record_scanbacks(tables, sent, AS_OF).appointments
    assert after.count() == count
    assert by_key(after, "appointment_id")[1].scanbacks_sent_at == dt.datetime(2026, 9, 21, 12)


def test_a_shift_polled_twice_counts_once(spark):
    tables = example_tables(spark)
    shifts = spark.sql(
        "SELECT * FROM VALUES (4404L, 1, TIMESTAMP '2026-09-26 02:14:15Z', CAST(NULL AS TIMESTAMP), 1, 27), "
        "(4404L, 2, TIMESTAMP '2026-09-26 02:14:15Z', TIMESTAMP '2026-09-26 03:01:40Z', 1, 27) "
        "AS t(shift_id, punch_count, actual_in, actual_out, gps_verified, checkin_distance_m)")
    after = completion.record_stamps(tables, shifts, AS_OF).appointments
    assert after.count() == 5 and by_key(after, "appointment_id")[4].checked_out_at is not None


def test_same_with_shuffled_joins(spark, shuffled_joins):
    test_a_request_sent_twice_counts_once(spark)
    test_reschedule_to_another_day(spark)
    test_no_shows_and_drops(spark)


def test_rows_without_a_key_are_all_inserted(spark):
    target = spark.sql("SELECT * FROM VALUES ('a', '1') AS t(key, value)")
    new = spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), '9'), (NULL, '9'), ('a', '2') AS t(key, value)")
    rows = changes.insert_or_ignore(target, new, ["key"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, [("a", "1"), (None, "9"), (None, "9")])) or len(rows) == 3


def test_merges_follow_to_the_last_survivor(spark):
    tables = example_tables(spark)
    more = tables.places.unionByName(tables.places.where("place_id = 2").withColumn("place_id", F.lit(3).cast("bigint")))
    tables = tables.replace(places=more)
    chain = spark.sql("SELECT * FROM VALUES (2L, 3L), (3L, 1L), (3L, 1L), (1L, 1L) AS t(place_id, survivor_id)")
    merged = places.merge_places(tables, chain, AS_OF)
    assert {r.place_id for r in merged.appointments.collect()} == {1}
    (left,) = merged.places.collect()
    assert (left.place_id, left.location_ext_id, left.updated_at) == (1, 5502, AS_OF)
    circle = spark.sql("SELECT * FROM VALUES (2L, 3L), (3L, 2L) AS t(place_id, survivor_id)")
    assert places.merge_places(tables, circle, AS_OF).places.count() == 3
