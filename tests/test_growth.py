"""What may not grow with the tables: state calls, lookups beside a finished run, rows shuffled for few questions."""

from __future__ import annotations

import random
import types

from pyspark.sql import types as T

from apptledger.operators import billing, lookups
from apptledger.plans import catalog
from apptledger.sources import starschema as star
from apptledger.streaming import keyed
from conftest import TESTDATA, make_tables


class Handle:
    """A state store in memory that counts what it is asked."""

    def __init__(self):
        self.calls, self.lists, self.timers = 0, {}, []

    def getListState(self, name, schema):  # noqa: N802
        return State(self, self.lists.setdefault(name, []))

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter(list(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class State:
    def __init__(self, handle, values):
        self.handle, self.values = handle, values

    def called(self):
        self.handle.calls += 1

    def get(self):
        self.called()
        return iter(list(self.values))

    def put(self, values):
        self.called()
        self.values[:] = values

    def appendValue(self, value):  # noqa: N802
        self.called()
        self.values.append(value)

    def appendList(self, values):  # noqa: N802
        self.called()
        self.values += values

    def clear(self):
        self.called()
        self.values.clear()


def watermark(ms):
    return types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_commands_of_a_slot_share_state_calls():
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    handle, step = Handle(), keyed.FirstWithin(schema, "k", 100 * keyed.MICROS)
    step.init(handle)
    rows = [{"k": f"c{i}", "n": i, "_at": i % 7 * keyed.MICROS} for i in range(500)]
    assert len(list(step.handleInputRows((0,), iter(rows), None))) == 500 and handle.calls < 10
    again = [{**r, "_at": r["_at"] + 50 * keyed.MICROS} for r in rows]
    assert not list(step.handleInputRows((0,), iter(again), None)) and len(handle.timers) == 1
    after = [{**r, "_at": r["_at"] + 100 * keyed.MICROS} for r in rows]
    assert len(list(step.handleInputRows((0,), iter(after), None))) == 500 and handle.calls < 20
    handle.timers.clear()
    list(step.handleExpiredTimer((0,), watermark(203_000), None))
    # Of the second acceptances those up to 103 seconds are forgotten.
    assert {k for k in step.known()} == {r["k"] for r in rows if r["_at"] > 3 * keyed.MICROS} and handle.timers == [204_000]
    handle.timers.clear()
    list(step.handleExpiredTimer((0,), watermark(300_000), None))
    assert not step.known() and not handle.timers


def test_shifts_of_a_slot_share_state_calls():
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "shift_id", "worker_id")] + [T.StructField("type", T.StringType())])
    handle, step = Handle(), keyed.Stays(schema, keyed.STAY, "shift_id", 3600 * keyed.MICROS)
    step.init(handle)
    rows = [{"event_id": 2 * i + late, "shift_id": i, "worker_id": 1, "type": "out" if late else "in", "_at": (i % 5 + 60 * late) * keyed.MICROS}
            for i in range(400) for late in (1, 0)]
    assert not list(step.handleInputRows((0,), iter(rows), None))
    handle.timers.clear()
    half = list(step.handleExpiredTimer((0,), watermark(30_000), None))
    assert not half and handle.timers == [60_000]
    handle.timers.clear()
    found = list(step.handleExpiredTimer((0,), watermark(61_000), None))
    handle.timers.clear()
    found += list(step.handleExpiredTimer((0,), watermark(100_000), None))
    assert sorted(r.shift_id for r in found) == list(range(400)) and all(r.actual_out - r.actual_in == 60 * keyed.MICROS for r in found)
    assert handle.calls < 40 and not handle.timers and not any(handle.lists.values())


def test_documents_of_an_applied_run_price_nothing_again(spark):
    after, made = catalog._billed(spark, str(TESTDATA))
    documents = billing.invoice_documents(after, made)
    # Lines are numbered by windows, appointments are priced with their clients' defaults.
    text = documents._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "default_signing_fee" not in text
    tables = star.tables(spark, str(TESTDATA))
    before = billing.invoice_documents(tables, billing.invoice_run(tables, star.AS_OF))
    assert documents.count() > 0 and documents.exceptAll(before).count() == 0 == before.exceptAll(documents).count()


def journal(spark, rng):
    return make_tables(spark, journal_index=[
        {"entry_id": i, "appointment_id": i, "journal_book": rng.choice(["A", "B", None]), "act_type": "jurat", "act_count": 1,
         "entry_no": rng.choice([f"{low:04d}", f"{low:04d}-{low + rng.randrange(400)}"])}
        for i, low in enumerate(rng.randrange(2000) for _ in range(300))])


def answers(tables, asked):
    return sorted(map(tuple, lookups.journal_entries_for(tables, asked).collect()))


def test_few_entries_go_to_the_pointers(spark, monkeypatch):
    """However many ask for them; where there are many, both sides are shuffled, with the same result."""
    rng = random.Random(4)
    tables = journal(spark, rng)
    asked = spark.createDataFrame([(i, rng.choice(["A", "B", None]), rng.choice([7, 100, 512, 1999])) for i in range(300)],
                                  "n int, journal_book string, entry int")
    met = lookups.journal_entries_for(tables, asked)
    text = met._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text and "_entry" in text
    by_broadcast = answers(tables, asked)
    monkeypatch.setattr(lookups, "BROADCAST_CELLS", 0)
    assert by_broadcast == answers(tables, asked) and len(by_broadcast) > 300
