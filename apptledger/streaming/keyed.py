"""Streams that keep a little state per key, with timers in event time.

Rows of one key are what a person or a shift sends, so a key's state is a few numbers. Asking the state store costs a
call each time, far more than the work on a key, so keys share ``SLOTS`` slots by a hash: a slot reads the state of its
keys in one go, appends what changes in one go, and has one timer. What a slot holds follows the keys in the
watermark's reach. The state store must be RocksDB (``keyed_state``), which holds it outside the JVM's heap. Instants travel as
microseconds, so no time zone or summer time of a machine plays a part. Rows without a key or a time are left out.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from apptledger.functions.times import local_time

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
#: Part of a stream's checkpoint: a query that goes on must keep the number it began with.
SLOTS = 1 << 11
SLOT = "_slot"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER_CONF)
    spark.conf.set(PROVIDER_CONF, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_CONF, before)


def milliseconds(at: int) -> int:
    """Timers count in these; not before the moment itself."""
    return -(-at // 1000)


def instants(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]


def sent(rows: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """``rows`` with instants in microseconds, their time as ``_at``, their key's slot, and a watermark."""
    late = set(instants(rows.schema))
    known = rows.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    return known.select(
        *[(F.unix_micros(c) if c in late else F.col(c)).alias(c) for c in rows.columns],
        F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias(SLOT),
        F.unix_micros(event_time).alias("_at"), F.col(event_time).alias("_event")).withWatermark("_event", delay)


def received(rows: DataFrame, times: list[str]) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in times}) if times else rows


def flat(schema: T.StructType) -> T.StructType:
    """The schema of ``sent`` rows, without the watermark's column."""
    late = set(instants(schema))
    return T.StructType([T.StructField(f.name, T.LongType() if f.name in late else f.dataType) for f in schema.fields])


class FirstWithin(StatefulProcessor):
    """The first row of a key, and again the first that comes ``ttl`` or more after the last one accepted.

    Rows pass as they arrive; those of one batch count in order of time, of equal times the least one.
    """

    def __init__(self, schema: T.StructType, key: str, ttl: int):
        self.names, self.key, self.ttl = schema.fieldNames(), key, ttl

    def init(self, handle) -> None:
        self.handle = handle
        # One entry for each batch that had rows accepted: their keys and times, as JSON. Of a key the last time counts.
        self.accepted = handle.getListState("accepted", "value string")

    def known(self) -> dict[object, int]:
        found: dict[object, int] = {}
        for (entry,) in self.accepted.get():
            for of, at in json.loads(entry):
                found[of] = max(at, found.get(of, at))
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[object, dict[int, tuple]] = {}
        for row in rows:
            values = tuple(row[n] for n in self.names)
            own = first.setdefault(row[self.key], {})
            if row["_at"] not in own or repr(values) < repr(own[row["_at"]]):
                own[row["_at"]] = values
        accepted = self.known()
        new, make = [], Row(*self.names)
        for of, own in first.items():
            last = before = accepted.get(of)
            for at in sorted(own):
                if last is None or at - last >= self.ttl:
                    last = at
                    yield make(*own[at])
            if last != before:
                new.append((of, last))
        if new:
            self.accepted.appendValue((json.dumps(new),))
            if not accepted:
                self.handle.registerTimer(milliseconds(min(at for _, at in new) + self.ttl))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Nothing older can arrive any more, so what comes next of such keys is accepted without a memory.
        until = timerValues.getCurrentWatermarkInMs()
        left = [(of, at) for of, at in self.known().items() if milliseconds(at + self.ttl) > until]
        if left:
            self.accepted.put([(json.dumps(left),)])
            self.handle.registerTimer(milliseconds(min(at for _, at in left) + self.ttl))
        else:
            self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_within(rows: DataFrame, key: str, event_time: str, ttl_seconds: int, delay: str) -> DataFrame:
    """See ``FirstWithin``. ``delay`` says how late rows may come; later ones are left out."""
    schema = flat(rows.schema)
    kept = sent(rows, key, event_time, delay).groupBy(SLOT).transformWithState(
        FirstWithin(schema, key, ttl_seconds * MICROS), schema, "append", "EventTime")
    return received(kept, instants(rows.schema))


class Timeline(StatefulProcessor):
    """Rows of a key in order of time, whenever they arrive.

    Rows wait until the watermark has passed them, so the result does not depend on how they fell into batches. What
    a subclass knows between rows is its ``memory``, plain values that JSON can hold; ``due`` names the next moment
    at which something happens without a row, and ``ring`` does it. A row at that very moment comes first.
    """

    def __init__(self, schema: T.StructType, out: T.StructType, key: str, order: list[str]):
        self.schema, self.out, self.key, self.order = schema, out, key, order
        self.names = schema.fieldNames()
        self.entry = T.StructType([T.StructField("key", schema[key].dataType), T.StructField("value", T.StringType())])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([*self.schema.fields]).add("_at", "long"))
        self.memory = handle.getListState("memory", self.entry)

    def start(self) -> dict:
        raise NotImplementedError

    def take(self, memory: dict, row: dict) -> list[tuple]:
        raise NotImplementedError

    def due(self, memory: dict) -> int | None:
        return None

    def ring(self, memory: dict, at: int) -> list[tuple]:
        return []

    def wake(self, at: int) -> None:
        """There is one timer, at the earliest moment asked for."""
        timers = list(self.handle.listTimers())
        if not timers or milliseconds(at) < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(milliseconds(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(*[row[n] for n in self.names], row["_at"]) for row in rows]
        self.waiting.appendList(new)
        self.wake(min(row[-1] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[object, list[dict]] = {}
        later = []
        for row in self.waiting.get():
            if row[-1] <= until:
                values = dict(zip([*self.names, "_at"], row, strict=True))
                ready.setdefault(values[self.key], []).append(values)
            else:
                later.append(tuple(row))
        memories = {of: json.loads(value) for of, value in self.memory.get()}
        found: list[tuple] = []
        moments = [row[-1] for row in later]
        left = []
        for of in memories.keys() | ready.keys():
            memory = memories.get(of) or self.start()
            found += self.passed(memory, ready.get(of, []), until)
            if memory != self.start():
                left.append((of, json.dumps(memory)))
            if (at := self.due(memory)) is not None:
                moments.append(at)
        for state, values in ((self.waiting, later), (self.memory, left)):
            if values:
                state.put(values)
            else:
                state.clear()
        # The one timer has just gone off.
        if moments:
            self.handle.registerTimer(milliseconds(min(moments)))
        make = Row(*self.out.fieldNames())
        return iter([make(*values) for values in found])

    def passed(self, memory: dict, rows: list[dict], until: int) -> list[tuple]:
        """What happens to one key up to ``until``, with these rows."""
        found: list[tuple] = []
        for row in sorted(rows, key=lambda r: (r["_at"], *[str(r[c]) for c in self.order])):
            while (at := self.due(memory)) is not None and at < row["_at"]:
                found += self.ring(memory, at)
            found += self.take(memory, row)
        while (at := self.due(memory)) is not None and at <= until:
            found += self.ring(memory, at)
        return found

    def close(self) -> None:
        pass


#: What comes first of punches at the same moment.
PUNCH_ORDER = ["type", "event_id"]


class Stays(Timeline):
    """Every stay of a shift, from a check-in to the next check-out.

    A check-in while one is open and a check-out while none is are repeated taps and change nothing. A stay that
    nobody ends within ``longest`` is given up.
    """

    def __init__(self, schema: T.StructType, out: T.StructType, key: str, longest: int):
        super().__init__(schema, out, key, [c for c in PUNCH_ORDER if c in schema.fieldNames()])
        self.longest = longest

    def start(self) -> dict:
        return {"in": None}

    def take(self, memory: dict, row: dict) -> list[tuple]:
        if row["type"] == "in" and memory["in"] is None:
            memory["in"], memory["worker"] = row["_at"], row["worker_id"]
        elif row["type"] == "out" and memory["in"] is not None:
            stay = (row["shift_id"], memory["worker"], memory["in"], row["_at"])
            self.forget(memory)
            return [stay]
        return []

    def forget(self, memory: dict) -> None:
        memory.clear()
        memory.update(self.start())

    def due(self, memory: dict) -> int | None:
        return None if memory["in"] is None else memory["in"] + self.longest

    def ring(self, memory: dict, at: int) -> list[tuple]:
        self.forget(memory)
        return []


class Watch(Timeline):
    """Alerts of a shift: a start that nobody checked in to, and a stay that nobody ended.

    Rows are plans (``starts_at``, ``ends_at``; a later plan replaces an earlier one, one without a start cancels) and
    punches. ``not_checked_in`` is due ``slack`` after the start if no check-in came by then; ``forgot_checkout``
    ``reminder`` after the planned end or, without a plan or where the stay began after that, ``longest`` after
    the check-in. Each is given once for a plan or a stay. What is known is forgotten ``keep`` after the last row.
    """

    def __init__(self, schema: T.StructType, out: T.StructType, key: str, slack: int, reminder: int, longest: int, keep: int, delay: int):
        super().__init__(schema, out, key, [c for c in PUNCH_ORDER if c in schema.fieldNames()])
        self.slack, self.reminder, self.longest, self.keep, self.delay = slack, reminder, longest, keep, delay

    def start(self) -> dict:
        return {}

    def take(self, memory: dict, row: dict) -> list[tuple]:
        at = memory["seen"] = row["_at"]
        memory.setdefault("shift", row["shift_id"])
        memory["worker"] = row["worker_id"] if row["worker_id"] is not None else memory.get("worker")
        if row["type"] == "planned":
            memory["from"], memory["to"] = row["starts_at"], row["ends_at"]
            memory["absent"] = None
            if row["starts_at"] is not None and not memory.get("came"):
                memory["absent"] = max(row["starts_at"] + self.slack, at)
        elif row["type"] == "in":
            memory["came"], memory["absent"] = True, None
            if memory.get("in") is None:
                memory["in"], memory["told"] = at, False
        elif row["type"] == "out":
            memory["in"] = None
        if memory.get("in") is not None and not memory["told"]:
            planned = None if memory.get("to") is None else memory["to"] + self.reminder
            end = planned if planned is not None and planned > memory["in"] else memory["in"] + self.longest
            memory["open"] = max(end, at)
        else:
            memory["open"] = None
        return []

    def due(self, memory: dict) -> int | None:
        moments = [memory.get("absent"), memory.get("open"), memory["seen"] + self.keep if memory else None]
        return min((m for m in moments if m is not None), default=None)

    def ring(self, memory: dict, at: int) -> list[tuple]:
        found, head = [], (memory["shift"], memory["worker"])
        if memory.get("absent") == at:
            found.append(("not_checked_in", *head, memory["from"], at, at + self.delay))
            memory["absent"] = None
        elif memory.get("open") == at:
            found.append(("forgot_checkout", *head, memory["in"], at, at + self.delay))
            memory["open"], memory["told"] = None, True
        else:
            memory.clear()
        return found


STAY = T.StructType([T.StructField(n, T.LongType()) for n in ("shift_id", "worker_id", "actual_in", "actual_out")])
ALERT = T.StructType([T.StructField("kind", T.StringType())] + [
    T.StructField(n, T.LongType()) for n in ("shift_id", "worker_id", "since", "due_at", "alert_at")])
LONGEST = 12 * 3600


def stays(
    punches: DataFrame, event_time: str = "ts", delay: str = "10 minutes", longest_seconds: int = LONGEST, offset: str = "+00:00",
) -> DataFrame:
    """One row per stay, ``delay`` after its check-out, on the business's day it began; see ``Stays``."""
    processor = Stays(flat(punches.schema), STAY, "shift_id", longest_seconds * MICROS)
    found = sent(punches, "shift_id", event_time, delay).groupBy(SLOT).transformWithState(
        processor, STAY, "append", "EventTime")
    return received(found, ["actual_in", "actual_out"]).select(
        local_time(F.col("actual_in"), offset).cast("date").alias("work_date"), "shift_id", "worker_id", "actual_in", "actual_out",
        (F.unix_seconds("actual_out") - F.unix_seconds("actual_in")).alias("seconds_on_site"))


def shift_alerts(
    feed: DataFrame, event_time: str = "ts", delay_minutes: int = 10, slack_minutes: int = 20, reminder_minutes: int = 15,
    longest_seconds: int = LONGEST, keep_hours: int = 48,
) -> DataFrame:
    """(kind, shift_id, worker_id, since, due_at, alert_at): see ``Watch``.

    ``feed`` holds plans and punches, told apart by ``type``. An alert leaves when the feed's time has reached ``alert_at``, which is
    ``delay_minutes`` after it was due, the time that punches may be late.
    """
    processor = Watch(
        flat(feed.schema), ALERT, "shift_id", slack_minutes * 60 * MICROS, reminder_minutes * 60 * MICROS, longest_seconds * MICROS,
        keep_hours * 3600 * MICROS, delay_minutes * 60 * MICROS)
    found = sent(feed, "shift_id", event_time, f"{delay_minutes} minutes").groupBy(SLOT).transformWithState(
        processor, ALERT, "append", "EventTime")
    return received(found, ["since", "due_at", "alert_at"])

