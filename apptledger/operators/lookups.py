"""Small questions asked of the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptledger.functions import times
from apptledger.model import OPEN_STATUSES, Tables
from apptledger.operators.joins import fits_broadcast, spread_join
from apptledger.plans.views import in_days
from apptledger.session import materialized


def commissions_expiring(tables: Tables, as_of: dt.date, days: int = 60) -> DataFrame:
    """Commissions that end within ``days``, those already over included."""
    limit = times.date_literal(as_of + dt.timedelta(days=days))
    return tables.notaries.where(F.col("commission_expires") <= limit).select(
        "notary_id", "notary_name", "commission_expires"
    )


def trips_between(tables: Tables, first: dt.date, last: dt.date) -> DataFrame:
    return tables.mileage.where(
        F.col("trip_date").between(times.date_literal(first), times.date_literal(last))
    ).select("trip_id", "trip_date", "miles", "from_label", "to_label", "purpose", "deduction")


def find_clients(tables: Tables, prefix: str, active_only: bool = False) -> DataFrame:
    """Clients whose name starts with ``prefix``, whatever its case."""
    pattern = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    rows = tables.clients.where(F.col("client_name").ilike(pattern))
    if active_only:
        rows = rows.where(F.col("is_active") == 1)
    return rows.select("client_id", "client_name", "payment_terms_days", "is_active")


def active_notaries(tables: Tables) -> DataFrame:
    return tables.notaries.where(F.col("is_active") == 1).select("notary_id", "notary_name", "worker_ext_id")


def shifts_between(shifts: DataFrame, first: dt.date, last: dt.date, status: str = "checked_out") -> DataFrame:
    return shifts.where(
        (F.col("status") == status)
        & F.col("work_date").between(times.date_literal(first), times.date_literal(last))
    )


def submissions_between(submissions: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Completion records sent in on these local dates, for reading a period in one go."""
    return submissions.where(times.in_local_days("submitted_at", first, last))


def with_punches(shifts: DataFrame) -> DataFrame:
    """Shifts somebody actually punched; the others record no completion."""
    return shifts.where(F.col("punch_count") > 0)


def worker_day(tables: Tables, notary_id: int, day: dt.date, except_id: int | None = None) -> DataFrame:
    """A worker's open appointments on a date, besides the one being booked."""
    rows = tables.appointments.where(
        F.col("status").isin(OPEN_STATUSES) & (F.col("notary_id") == notary_id)
        & in_days(tables.appointments, day, day)
    )
    if except_id is not None:
        rows = rows.where(F.col("appointment_id") != except_id)
    return rows.select("appointment_id", "appointment_no", "scheduled_start", "duration_minutes")


def collisions(
    tables: Tables, notary_id: int, start: dt.datetime, minutes: int, buffer_minutes: int = 30,
    except_id: int | None = None,
) -> DataFrame:
    """Which of that day's appointments a booking would collide with."""
    end = times.plus_minutes("scheduled_start", "duration_minutes")
    pad = dt.timedelta(minutes=buffer_minutes)
    return worker_day(tables, notary_id, start.date(), except_id).where(
        (F.col("scheduled_start") < times.local_literal(start + dt.timedelta(minutes=minutes) + pad))
        & (end > times.local_literal(start - pad))
    )


def entry_bounds() -> tuple[Column, Column]:
    """First and last entry number of a journal pointer, which holds one number or a range."""
    bounds = F.split("entry_no", "-")
    first = F.try_element_at(bounds, F.lit(1)).try_cast("bigint")
    return first, F.coalesce(F.try_element_at(bounds, F.lit(2)).try_cast("bigint"), first)


def shifted(number: Column, level: Column) -> Column:
    """``number`` divided by ``2 ** level``, rounded down."""
    return F.call_function("shiftright", number, level)


def aligned_pieces(first: Column, last: Column) -> Column:
    """A range of numbers as an array of (level, block): blocks of ``2 ** level`` numbers that start at a multiple of
    their size, at most two of each level, each number in one of them. Empty where the range is."""
    length = last - first + 1

    def at(level: Column) -> Column:
        # Whole blocks of this level inside the range; an odd end cannot be part of a block twice as large.
        low, high = -shifted(-first, level), shifted(last + 1, level)
        return F.filter(F.array(
            F.struct(level.alias("level"), F.when((low < high) & (low % 2 != 0), low).alias("block")),
            F.struct(level.alias("level"), F.when((low < high) & (high % 2 != 0), high - 1).alias("block")),
        ), lambda piece: piece["block"].isNotNull())

    levels = F.sequence(F.lit(0), F.floor(F.log2(length.cast("double"))).cast("int"))
    return F.when(length > 0, F.flatten(F.transform(levels, at)))


#: Blocks of asked entries that are sent to every executor at most; more are shuffled.
BROADCAST_CELLS = 500_000


def journal_entries_for(tables: Tables, questions: DataFrame) -> DataFrame:
    """Pointers that cover the entry each question asks for; ``questions`` holds ``journal_book``, ``entry`` and
    columns of its own. Questions that no pointer covers are left out.

    Ranges are cut into aligned blocks and each question looks up the one block of every size that holds its
    number, so ranges of any length meet by equality: a range of n numbers takes some 2 log n rows, a question
    one per size that may occur. A question meets a pointer once, as a range's blocks do not overlap. Each entry is
    looked up once, however many ask for it, and its pointers then meet the questions.
    """
    first, last = entry_bounds()
    pointers = tables.journal_index.where((first >= 0) & F.col("journal_book").isNotNull())
    pieces = pointers.select(
        "journal_book", F.inline(aligned_pieces(first, last)), "entry_id", "appointment_id", "entry_no", "act_type", "act_count")
    longest = pointers.agg(F.coalesce(F.floor(F.log2(F.max(last - first + 1).cast("double"))).cast("int"), F.lit(0))).first()[0]
    known = questions.where(F.col("journal_book").isNotNull() & F.col("entry").isNotNull()).withColumn(
        "_entry", F.col("entry").cast("bigint"))
    # Many may ask for one entry: it is looked up once. Stored, so that its size is known.
    entries = materialized(known.select("journal_book", "_entry").distinct(), "asked-entries")
    cells = entries.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(longest)))).withColumn(
        "block", shifted(F.col("_entry"), F.col("level")))
    cell = ["journal_book", "level", "block"]
    # Pointers are the larger side: few entries go to them, and only what covers one is shuffled.
    few = fits_broadcast(entries) and entries.count() * (longest + 1) <= BROADCAST_CELLS
    covering = pieces.join(F.broadcast(cells), cell) if few else spread_join(cells, pieces, cell, spread_by=["_entry"])
    found = covering.select("journal_book", "_entry", "entry_id", "appointment_id", "entry_no", "act_type", "act_count")
    met = spread_join(known, found, ["journal_book", "_entry"], spread_by=questions.columns)
    return met.select(*questions.columns, "entry_id", "appointment_id", "entry_no", "act_type", "act_count")


def find_journal(tables: Tables, book: str, entry: int) -> DataFrame:
    """Pointers of a book that cover an entry number, single or as a range."""
    first, last = entry_bounds()
    return tables.journal_index.where(
        (F.col("journal_book") == book) & (first <= entry) & (last >= entry)
    ).select("entry_id", "appointment_id", "journal_book", "entry_no", "act_type", "act_count")


def journal_for(tables: Tables, appointment_ids: DataFrame) -> DataFrame:
    wanted = appointment_ids.select("appointment_id").distinct()
    return tables.journal_index.join(wanted, "appointment_id", "left_semi").select(
        "entry_id", "appointment_id", "journal_book", "entry_no", "act_type", "act_count"
    )


def newest_records(submissions: DataFrame, by: str = "event_ext_id", limit: int = 5) -> DataFrame:
    """The newest records per event (or per ``by``).

    Spark cuts each task's rows to the limit before the shuffle, so a key with
    very many records costs no more than others.
    """
    newest_first = Window.partitionBy(by).orderBy(F.desc("submitted_at"), F.desc("submission_id"))
    return submissions.withColumn("_rank", F.row_number().over(newest_first)).where(
        F.col("_rank") <= limit
    ).drop("_rank")
