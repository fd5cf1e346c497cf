"""Data-quality rules: each returns the rows that break it.

Every rule yields ``rule, table_name, key, detail``. A rule is broken only when
its test is definitely false: a NULL passes unless the column is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.functions import naming, times
from apptledger.model import ACT_TYPES, CLIENT_TYPES, PAYOUT_TYPES, SIGNING_TYPES, STATUSES, Tables
from apptledger.operators.joins import fits_broadcast, lookup_join, spread_join
from apptledger.session import materialized

PRIMARY_KEYS = {
    "settings": "key", "clients": "client_id", "places": "place_id", "notaries": "notary_id",
    "appointments": "appointment_id", "journal_index": "entry_id", "mileage": "trip_id",
    "invoices": "invoice_id", "payouts": "payout_id",
}

# Allowed entries per column.
ENUMS = {
    ("clients", "client_type"): CLIENT_TYPES,
    ("notaries", "payout_type"): PAYOUT_TYPES,
    ("appointments", "signing_type"): SIGNING_TYPES,
    ("appointments", "status"): STATUSES,
    ("journal_index", "act_type"): ACT_TYPES,
}

# Required columns.
REQUIRED = {
    "clients": ["client_name", "client_type", "payment_terms_days"],
    "places": ["normalized_address", "address"],
    "notaries": ["notary_name"],
    "appointments": ["client_id", "signing_type", "place_id", "scheduled_start", "status"],
    "journal_index": ["appointment_id", "journal_book", "entry_no", "act_type", "act_count"],
    "mileage": ["trip_date", "miles"],
    "invoices": ["client_id", "invoice_date", "total_amount"],
    "payouts": ["notary_id", "appointment_id"],
}

# Columns without repeats.
UNIQUE = [
    ("settings", "key"), ("places", "normalized_address"), ("notaries", "worker_ext_id"),
    ("appointments", "appointment_no"), ("appointments", "shift_ext_id"),
    ("invoices", "invoice_number"), ("payouts", "appointment_id"),
]

# Fixed values: (child table, column, parent table).
REFERENCES = [
    ("appointments", "client_id", "clients"),
    ("appointments", "place_id", "places"),
    ("appointments", "notary_id", "notaries"),
    ("appointments", "rescheduled_from", "appointments"),
    ("journal_index", "appointment_id", "appointments"),
    ("mileage", "appointment_id", "appointments"),
    ("invoices", "client_id", "clients"),
    ("payouts", "notary_id", "notaries"),
    ("payouts", "appointment_id", "appointments"),
]

# Local start text: date, T, a two-digit hour below 30, minutes; no offset, no Z.
START_TEXT = r"^\d{4}-\d{2}-\d{2}T[0-2]\d:[0-5]\d"
START_OFFSET = r"T.*[+-]"


def _union(parts: list[DataFrame]) -> DataFrame:
    """Pairwise, so that no part is analysed once per part that follows it."""
    while len(parts) > 1:
        pairs = [parts[i:i + 2] for i in range(0, len(parts), 2)]
        parts = [pair[0].unionByName(pair[1]) if len(pair) == 2 else pair[0] for pair in pairs]
    return parts[0]


def _named(column: str) -> Column:
    return F.concat(F.lit(f"{column}="), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))


# A row rule: its name, the table, the test that must hold, what to report.
RowRule = tuple[str, str, Column, Column]


def enum_rules() -> list[RowRule]:
    return [
        ("enum", table, F.col(column).isin(allowed), _named(column)) for (table, column), allowed in ENUMS.items()
    ]


def range_rules() -> list[RowRule]:
    return [
        ("range", "appointments", F.col("duration_minutes").between(15, 480), _named("duration_minutes")),
        ("range", "journal_index", F.col("act_count") >= 1, _named("act_count")),
        ("range", "mileage", F.col("miles") >= 0, _named("miles")),
    ]


def required_rules() -> list[RowRule]:
    return [
        ("required", table, F.col(column).isNotNull(), F.lit(column))
        for table, columns in REQUIRED.items() for column in columns
    ]


def single_day_rules() -> list[RowRule]:
    """An appointment ends after it starts and on the same date."""
    end = times.plus_minutes("scheduled_start", "duration_minutes")
    holds = (end > F.col("scheduled_start")) & (F.to_date(end) == F.to_date("scheduled_start"))
    return [("single_day", "appointments", holds, times.local_text(end))]


def check_rows(tables: Tables, rules: list[RowRule]) -> DataFrame:
    """All row rules in one pass over each table they concern."""
    def broken_in(table: str) -> DataFrame:
        found = F.array_compact(F.array(*[
            F.when(~F.coalesce(holds, F.lit(True)), F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
            for rule, of, holds, detail in rules if of == table
        ]))
        key = F.col(PRIMARY_KEYS[table]).cast("string").alias("key")
        return getattr(tables, table).select(key, F.inline(found)).select(
            "rule", F.lit(table).alias("table_name"), "key", "detail"
        )

    return _union([broken_in(table) for table in dict.fromkeys(table for _, table, _, _ in rules)])


def check_enums(tables: Tables) -> DataFrame:
    return check_rows(tables, enum_rules())


def check_ranges(tables: Tables) -> DataFrame:
    return check_rows(tables, range_rules())


def check_required(tables: Tables) -> DataFrame:
    return check_rows(tables, required_rules())


def check_single_day(tables: Tables) -> DataFrame:
    return check_rows(tables, single_day_rules())


def is_local_start(text: Column | str) -> Column:
    """Whether raw start text has the accepted shape. Trailing text after the
    minutes passes here and fails when the time is parsed."""
    text = times.col(text)
    return text.rlike(START_TEXT) & ~text.rlike(START_OFFSET) & ~text.endswith("Z")


def parse_local_start(text: Column | str) -> Column:
    """The local time, NULL when the text is not one."""
    text = times.col(text)
    return F.when(is_local_start(text), text.try_cast("timestamp_ntz"))


def check_start_text(raw: DataFrame, key: str, column: str) -> DataFrame:
    """Raw bookings whose start text is malformed or no real time."""
    text = F.col(column)
    detail = F.when(~is_local_start(text), "format").when(parse_local_start(text).isNull(), "not a time")
    return raw.where(text.isNotNull() & detail.isNotNull()).select(
        F.lit("start_text").alias("rule"), F.lit("appointments").alias("table_name"),
        F.col(key).cast("string").alias("key"), F.concat(detail, F.lit(": "), text).alias("detail"),
    )


def facts(
    tables: Tables, rules: list[RowRule], unique: list[tuple[str, str]], references: list[tuple[str, str, str]]
) -> DataFrame:
    """What the rules need to know of each row, in one pass over each table; stored.

    ``kind`` is ``rule`` for a broken row rule, ``unique`` for a value that must not repeat, ``child`` for an id that
    points at table ``name``, ``parent`` for a row that ids may point at. Only ids and unique values are kept.
    """
    def fact(kind: str, name: str, *, ref: Column | None = None, text: Column | None = None, detail: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(name).alias("name"), (none if ref is None else ref).cast("bigint").alias("ref"),
            (none if text is None else text).cast("string").alias("text"), (none if detail is None else detail).cast("string").alias("detail"))

    def of(table: str) -> list[Column]:
        found = [F.when(~F.coalesce(holds, F.lit(True)), fact("rule", rule, detail=detail))
                 for rule, owner, holds, detail in rules if owner == table]
        found += [F.when(F.col(c).isNotNull(), fact("unique", f"{t}.{c}", text=F.col(c))) for t, c in unique if t == table]
        found += [F.when(F.col(c).isNotNull(), fact("child", parent, ref=F.col(c), detail=F.lit(c)))
                  for child, c, parent in references if child == table]
        if any(parent == table for _, _, parent in references):
            owner = F.when(F.col("is_owner") == 1, "owner") if table == "notaries" else None
            found.append(fact("parent", table, ref=F.col(PRIMARY_KEYS[table]), detail=owner))
        return found

    concerned = dict.fromkeys([t for _, t, _, _ in rules] + [t for t, _ in unique] + [t for r in references for t in (r[0], r[2])])
    rows = [
        getattr(tables, table).select(
            F.lit(table).alias("table_name"), F.col(PRIMARY_KEYS[table]).cast("string").alias("key"),
            F.inline(F.array_compact(F.array(*of(table)))))
        for table in concerned
    ]
    return materialized(_union(rows), "facts")


def judged(known: DataFrame) -> DataFrame:
    """The violations that ``facts`` tell of.

    One exchange counts each value and id by its kinds, after every task has added up its own. What is wrong is a short
    list as a rule; the rows that point at it are found by joining it back, by broadcast if it is small, else with
    its hot ids spread.
    """
    held = known.where(F.col("kind") != "rule")

    def number(kind: str) -> Column:
        return F.sum((F.col("kind") == kind).cast("int")).alias(kind)

    counted = held.groupBy("name", "ref", "text").agg(
        number("unique"), number("child"), number("parent"), F.max(F.col("detail") == "owner").alias("owner"))
    wrong = materialized(counted.where(
        (F.col("unique") > 1) | ((F.col("child") > 0) & ((F.col("parent") == 0) | F.col("owner")))), "wrong")
    repeated = wrong.where(F.col("unique") > 1).select(
        F.lit("unique").alias("rule"), F.split_part("name", F.lit("."), F.lit(1)).alias("table_name"), F.col("text").alias("key"),
        F.concat(F.split_part("name", F.lit("."), F.lit(2)), F.lit(" x"), F.col("unique").cast("string")).alias("detail"))
    missed = wrong.where(F.col("child") > 0).select("name", "ref", (F.col("parent") == 0).alias("orphan"))
    children = known.where(F.col("kind") == "child").select("name", "ref", "table_name", "key", "detail")
    if fits_broadcast(missed):
        pointing = children.join(F.broadcast(missed), ["name", "ref"])
    else:
        pointing = spread_join(children, missed, ["name", "ref"], spread_by=["table_name", "key"])
    # An owner is no fault of the appointments that name one.
    pointing = pointing.where(F.col("orphan") | (F.col("table_name") == "payouts")).select(
        F.when(F.col("orphan"), "reference").otherwise("owner_payout").alias("rule"), "table_name", "key",
        F.concat("detail", F.lit("="), F.col("ref").cast("string")).alias("detail"))
    broken = known.where(F.col("kind") == "rule").select(F.col("name").alias("rule"), "table_name", "key", "detail")
    return _union([broken, repeated, pointing])


def check_unique(tables: Tables) -> DataFrame:
    """One row per repeated value, with how often it occurs."""
    return judged(facts(tables, [], UNIQUE, []))


def check_references(tables: Tables) -> DataFrame:
    """Ids that point at no row."""
    return judged(facts(tables, [], [], REFERENCES)).where(F.col("rule") == "reference")


def check_owner_payouts(tables: Tables) -> DataFrame:
    """Owners are never paid out."""
    return judged(facts(tables, [], [], [("payouts", "notary_id", "notaries")])).where(F.col("rule") == "owner_payout")


def all_violations(tables: Tables) -> DataFrame:
    rules = [*enum_rules(), *range_rules(), *required_rules(), *single_day_rules()]
    return judged(facts(tables, rules, UNIQUE, REFERENCES))


def existing_for(tables: Tables, incoming: DataFrame, table: str) -> DataFrame:
    """For rows refused as repeats, the id of the row that is already there.

    ``incoming`` has ``request_id`` and the unique column of ``table``: an
    address for places, a worker id for notaries, an appointment for payouts.
    """
    column, key = {
        "places": ("normalized_address", "place_id"),
        "notaries": ("worker_ext_id", "notary_id"),
        "payouts": ("appointment_id", "payout_id"),
    }[table]
    rows = incoming
    if table == "places" and column not in rows.columns:
        rows = rows.withColumn(column, naming.normalized_address())
    known = getattr(tables, table).where(F.col(column).isNotNull()).select(
        column, F.col(key).alias("existing_id")
    )
    return lookup_join(
        rows.select("request_id", column), known, column, spread_by=["request_id"], bound=getattr(tables, table)
    )
