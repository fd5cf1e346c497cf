"""Colliding pairs and entry ranges against comparisons of everything with everything."""

from __future__ import annotations

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from apptledger.operators import lookups, scheduling
from apptledger.plans.catalog import QUERIES
from apptledger.sources import starschema as star
from conftest import TESTDATA, make_tables


def busy(spark, rng, rows):
    """One worker with most of the bookings, same starts, nights, missing durations and closed rows among them."""
    start = dt.datetime(2026, 9, 1)
    return make_tables(spark, appointments=[{
        "appointment_id": i, "appointment_no": f"A-{i}", "client_id": 1, "place_id": 1, "signing_type": "heloc",
        "notary_id": rng.choice([1, 1, 1, 2, None]), "status": rng.choice(["confirmed", "confirmed", "requested", "completed"]),
        "scheduled_start": (start + dt.timedelta(minutes=rng.randrange(0, 3 * 1440, 5))).isoformat(),
        "duration_minutes": rng.choice([15, 45, 60, 200, 480, None]),
    } for i in range(rows)])


def plain_pairs(rows, pad):
    found = {}
    known = [r for r in rows if r.notary_id is not None and r.duration_minutes is not None and r.status in ("confirmed", "requested")]
    for a in known:
        for b in known:
            first = (a.scheduled_start, a.appointment_id) < (b.scheduled_start, b.appointment_id)
            end = a.scheduled_start + dt.timedelta(minutes=a.duration_minutes)
            if first and a.notary_id == b.notary_id and a.scheduled_start.date() == b.scheduled_start.date() \
                    and b.scheduled_start < end + dt.timedelta(minutes=pad):
                found[a.appointment_id, b.appointment_id] = (b.scheduled_start - end) // dt.timedelta(minutes=1)
    return found


def test_every_colliding_pair_once(spark):
    tables = busy(spark, random.Random(2), 260)
    for pad in (0, 30, 200):
        pairs = scheduling.conflict_pairs(tables, dt.date(2026, 9, 1), dt.date(2026, 9, 3), pad).collect()
        assert {(r.earlier, r.later): r.gap_minutes for r in pairs} == plain_pairs(tables.appointments.collect(), pad)
        assert len(pairs) == len({(r.earlier, r.later) for r in pairs}) > 50
    one = scheduling.conflict_pairs(tables, dt.date(2026, 9, 2), dt.date(2026, 9, 2), 30)
    assert {r.appointment_date for r in one.collect()} == {dt.date(2026, 9, 2)}


def test_pairs_are_the_ones_that_conflicts_count(spark):
    tables = star.tables(spark, str(TESTDATA))
    pairs = scheduling.conflict_pairs(tables, dt.date(2026, 8, 1), dt.date(2026, 12, 1)).collect()
    counts = collections.Counter(i for r in pairs for i in (r.earlier, r.later))
    assert counts == {r.appointment_id: r.conflicts for r in scheduling.schedule_conflicts(tables).collect()}


def test_a_pair_is_not_formed_twice(spark):
    """The join yields little more than its result: no window meets the same one in two slots."""
    tables = busy(spark, random.Random(3), 200)
    pairs = scheduling.conflict_pairs(tables, dt.date(2026, 9, 1), dt.date(2026, 9, 3), 30)
    assert pairs.count() == pairs.dropDuplicates(["earlier", "later"]).count()
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()


def at_starts(spark, starts):
    """Hour-long bookings of one worker, ``(id, minute past nine)``."""
    return make_tables(spark, appointments=[{
        "appointment_id": i, "appointment_no": f"A-2026-{i}", "client_id": 1, "place_id": 1, "signing_type": "heloc", "notary_id": 1,
        "status": "confirmed", "scheduled_start": f"2026-09-01T09:{minute:02d}:00", "duration_minutes": 60,
    } for i, minute in starts])


def test_lots_lose_and_repeat_no_pair(spark, monkeypatch):
    """Bookings that start together fill several lots; ids that come twice or not at all stay the rows they are."""
    monkeypatch.setattr(scheduling, "LOT_ROWS", 4)
    starts = [(i, i % 3 * 15) for i in range(60)] + [(7, 15), (None, 0), (None, 30)]
    day = dt.date(2026, 9, 1)
    pairs = scheduling.conflict_pairs(at_starts(spark, starts), day, day, 30).select("earlier", "later", "gap_minutes").collect()
    expected = [(a, b, n - m - 60) for a, m in starts for b, n in starts if m < n or (m == n and None not in (a, b) and a < b)]
    assert collections.Counter(map(tuple, pairs)) == collections.Counter(expected)
    joined = scheduling.conflict_pairs(at_starts(spark, starts), day, day, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline(members" in joined


def test_pairs_are_stored_in_few_bytes(spark, tmp_path):
    """Their number grows with the square of a worker's bookings; what is written for each is a fraction of a byte."""
    day = dt.date(2026, 9, 1)
    pairs = scheduling.conflict_pairs(at_starts(spark, [(i * 7919 % 1_000_003, i % 4 * 15) for i in range(1600)]), day, day, 30)
    pairs.write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1600 * 1599 // 2
    assert size < 1600 * 1599 // 2


def test_a_pair_costs_no_more_than_its_copy(spark):
    """Dates are written and gaps counted once for two lots, and the join does not hold what they unfold to."""
    plan = QUERIES["conflict_pairs"](spark, str(TESTDATA))._jdf.queryExecution().optimizedPlan().toString()
    unfolding, joining = plan.split("Repartition ", 1)
    assert unfolding.count("Generate inline(") == 2 and "Join" not in unfolding and "Join" in joining
    above = unfolding.split("Generate inline(")[0]
    assert "cast(" not in above and "FLOOR" not in above


def test_pairs_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    """A few hundred rows in few bytes make many pairs, all in one slot; they are not put together in few tasks."""
    monkeypatch.setattr(scheduling, "TASK_PAIRS", 20_000)
    day, starts = dt.date(2026, 9, 1), [(i, i % 4 * 15) for i in range(1600)]
    monkeypatch.setattr(scheduling, "LOT_ROWS", 8)
    pairs = scheduling.conflict_pairs(at_starts(spark, starts), day, day, 30)
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1600 * 1599 // 2 and len(tasks) > 60
    assert max(tasks) < sum(tasks) / 10


def test_pieces_cover_a_range_once(spark):
    ranges = [(0, 0), (1, 1), (1, 1_000_000), (7, 8), (255, 257), (0, 2**40), (5, 4), (12345, 99999), (2**53 + 1, 2**53 + 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, first long, last long")
    rows = df.select("i", F.inline(lookups.aligned_pieces(F.col("first"), F.col("last")))).collect()
    for i, (first, last) in enumerate(ranges):
        spans = sorted((r.block << r.level, (r.block + 1 << r.level) - 1) for r in rows if r.i == i)
        assert [a for a, _ in spans[1:]] == [b + 1 for _, b in spans[:-1]]
        assert (spans[0][0], spans[-1][1]) == (first, last) if last >= first else not spans
        assert len(spans) <= 2 * max(last - first + 1, 1).bit_length()


def test_questions_meet_their_ranges(spark):
    rng = random.Random(9)
    entries = ["0412", "0412-0418", "0001-1000000", "500", "9-3", "x", None, "20-"]
    for _ in range(120):
        low = rng.randrange(1, 2000)
        entries.append(f"{low:04d}-{low + rng.choice([0, 1, 7, 64, 900, 50_000])}")
    tables = make_tables(spark, journal_index=[
        {"entry_id": i, "appointment_id": i, "journal_book": rng.choice(["A", "B"]), "entry_no": e, "act_type": "jurat", "act_count": 1}
        for i, e in enumerate(entries)])
    questions = [(i, rng.choice(["A", "B", "C", None]), rng.choice([rng.randrange(0, 2500), 412, 1_000_000, 1_000_001])) for i in range(200)]
    asked = spark.createDataFrame([*questions, (900, "A", None)], "n int, journal_book string, entry long")
    got = sorted((r.n, r.entry_id) for r in lookups.journal_entries_for(tables, asked).collect())

    def bounds(text):
        parts = (text or "").split("-")
        if not parts[0].isdigit():
            return None
        return int(parts[0]), int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else int(parts[0])

    rows = [(r.entry_id, r.journal_book, bounds(r.entry_no)) for r in tables.journal_index.collect()]
    expected = sorted((n, i) for n, book, entry in questions for i, b, span in rows if b == book and span and span[0] <= entry <= span[1])
    assert got == expected and len(got) > 300
    for n, book, entry in [q for q in questions if q[1]][:3]:
        assert sorted(i for k, i in got if k == n) == sorted(r.entry_id for r in lookups.find_journal(tables, book, entry).collect())
