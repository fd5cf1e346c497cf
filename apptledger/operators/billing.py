"""Invoice runs: headers, lines, line-item documents and payment marks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.functions import money, naming, times
from apptledger.model import BILLABLE_STATUSES, LINES, SCHEMAS, Tables, conform
from apptledger.operators.changes import apply_changes
from apptledger.operators.joins import lookup_join
from apptledger.operators.numbering import assign_ids
from apptledger.plans.views import priced
from apptledger.session import materialized
from apptledger.settings import setting

# A document holds this many lines; a longer invoice goes on in further parts, each
# full before the next begins.
LINES_PER_DOCUMENT = 4096
# Lines are ranked within ranges of this many ids, whatever a client's number of lines.
ID_RANGE = 4096

# The fields of one line item, in output order.
LINE_ITEM = T.StructType([
    T.StructField("appointment_no", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("order_ref", T.StringType()),
    T.StructField("signing_fee", T.DoubleType()),
    T.StructField("print_fee", T.DoubleType()),
    T.StructField("trip_fee", T.DoubleType()),
    T.StructField("no_sign_fee", T.DoubleType()),
    T.StructField("other_fee", T.DoubleType()),
    T.StructField("billable", T.DoubleType()),
    T.StructField("shift_id", T.LongType()),
])

_LINE_SOURCE = {
    "date": "appointment_date", "type": "signing_type", "order_ref": "client_order_ref",
    "billable": "billable_total", "shift_id": "shift_ext_id",
}


def invoice_lines(tables: Tables, client_ids: DataFrame | None = None) -> DataFrame:
    """Priced, uninvoiced appointments with something to bill."""
    rows = priced(tables.appointments.where(F.col("invoiced") == 0)).where(F.col("billable_total") > 0)
    if client_ids is not None:
        wanted = client_ids.select("client_id").distinct()
        rows = lookup_join(rows, wanted, "client_id", spread_by=["appointment_id"], bound=tables.clients)
    return rows


def invoice_run(tables: Tables, as_of: dt.datetime, client_ids: DataFrame | None = None) -> DataFrame:
    """One numbered invoice header per client with open work.

    The totals are stored, since numbering and every later step of the run use
    them: the appointments are aggregated once.
    """
    totals = materialized(
        invoice_lines(tables, client_ids).groupBy("client_id").agg(
            F.sum("billable_total").alias("total_amount"),
            F.count(F.lit(1)).alias("line_count"),
        ), "invoice-totals")
    headers = totals.join(tables.clients.select("client_id", "payment_terms_days"), "client_id")
    last = tables.invoices.agg(F.max("invoice_id")).scalar()
    prefix, has_prefix = setting(tables.settings, "invoice_prefix"), setting(tables.settings, "has_invoice_prefix")
    invoice_date = times.date_literal(as_of.date())
    return (
        assign_ids(headers, "client_id", "invoice_id", last)
        .withColumn("invoice_date", invoice_date)
        .withColumn("due_date", money.due_date("invoice_date", "payment_terms_days"))
        .withColumn("invoice_number", naming.invoice_number(prefix, has_prefix))
        .select(
            "invoice_id", "client_id", "invoice_number", "invoice_date", "due_date", "payment_terms_days",
            F.col("total_amount").cast("decimal(22,2)").alias("total_amount"), "line_count",
        )
    )


def document_part(line_no: Column | str = "line_no") -> Column:
    """0 for the first ``LINES_PER_DOCUMENT`` lines, 1 for the next, and so on."""
    return F.floor((times.col(line_no) - 1) / F.lit(LINES_PER_DOCUMENT)).cast("bigint")


def numbered_lines(lines: DataFrame, owner: str) -> DataFrame:
    """``line_no`` from 1 for each owner's lines, by appointment, and the ``part_no`` it falls in.

    Lines are ranked within ranges of ids, which are unique, so a task ranks
    ``ID_RANGE`` lines of an owner at most; each range starts where the owner's earlier
    ones end. Only the counts of ranges meet in one place, not the lines.
    """
    ranged = lines.withColumn("_range", F.floor(F.col("appointment_id") / F.lit(ID_RANGE)))
    within = Window.partitionBy(owner, "_range")
    earlier = Window.partitionBy(owner).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(owner, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        owner, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    ranked = ranged.withColumn("_rank", F.row_number().over(within.orderBy("appointment_id")))
    numbered = ranked.join(starts, [owner, "_range"])
    return numbered.withColumn("line_no", (F.col("_start") + F.col("_rank")).cast("bigint")).withColumn("part_no", document_part()).drop(
        "_range", "_rank", "_start"
    )


def run_lines(tables: Tables, headers: DataFrame) -> DataFrame:
    """The lines that a run bills, as rows of ``invoice_lines``, for ``headers`` that are not applied yet."""
    wanted = headers.select("client_id", "invoice_id")
    lines = numbered_lines(invoice_lines(tables), "client_id")
    billed = lookup_join(lines, wanted, "client_id", spread_by=["appointment_id"], bound=tables.clients)
    return conform(billed, LINES)


def lines_of(tables: Tables, headers: DataFrame) -> DataFrame:
    """The lines of these invoices, whether their run is applied already or not."""
    known = headers.select("client_id", "invoice_id")
    wanted = known.select("invoice_id").distinct()
    stored = lookup_join(tables.invoice_lines, wanted, "invoice_id", spread_by=["line_no"], bound=headers)
    stored = stored.select(*SCHEMAS[LINES].fieldNames())
    # Looked at first: pricing all appointments once more, with the lookups that takes, is for runs not applied yet.
    unapplied = materialized(known.join(tables.invoices.select("invoice_id"), "invoice_id", "left_anti"), "unapplied")
    return stored if unapplied.isEmpty() else stored.unionByName(run_lines(tables, unapplied))


def further_lines(lines: DataFrame) -> DataFrame:
    """Lines beyond the document that an invoice's own row holds."""
    return lines.where(F.col("line_no") > LINES_PER_DOCUMENT)


def line_documents(lines: DataFrame) -> DataFrame:
    """JSON arrays of line items in their order, ``LINES_PER_DOCUMENT`` to a part."""
    item = F.struct(*[
        F.col(_LINE_SOURCE.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in LINE_ITEM.fields
    ])
    parts = lines.withColumn("part_no", document_part()).groupBy("invoice_id", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", item.alias("item")))).alias("lines"))
    return parts.select(
        "invoice_id", "part_no", F.size("lines").alias("lines_in_part"),
        F.to_json(F.transform("lines", lambda x: x["item"]), {"ignoreNullFields": "false"}).alias("line_items"))


def invoice_documents(tables: Tables, headers: DataFrame) -> DataFrame:
    """All line items of these invoices as JSON, before a run is applied and any time after."""
    numbers = headers.select("invoice_id", "invoice_number")
    documents = lookup_join(line_documents(lines_of(tables, headers)), numbers, "invoice_id", spread_by=["part_no"], bound=headers)
    return documents.select("invoice_id", "invoice_number", "part_no", "lines_in_part", "line_items")


def lines_from_json(invoices: DataFrame) -> DataFrame:
    """Rows of ``invoice_lines`` as far as the JSON on the invoices' rows goes."""
    items = F.from_json("line_items", T.ArrayType(LINE_ITEM))
    rows = invoices.where(F.col("line_items").isNotNull()).select("invoice_id", F.posexplode(items).alias("at", "item"))
    named = rows.select("invoice_id", (F.col("at") + 1).alias("line_no"), "item.*")
    return conform(named.withColumnsRenamed({k: v for k, v in _LINE_SOURCE.items()}), LINES)


def explode_line_items(documents: DataFrame) -> DataFrame:
    """One row per line item read back from its JSON."""
    items = F.from_json("line_items", T.ArrayType(LINE_ITEM))
    keys = [c for c in documents.columns if c not in ("line_items", "lines_in_part")]
    return documents.select(*keys, F.explode_outer(items).alias("item")).select(*keys, "item.*")


def mark_invoiced(tables: Tables, client_ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Appointments with every finished row of these clients flagged, whatever it bills."""
    billed = client_ids.select("client_id").distinct().withColumn("_billed", F.lit(1))
    rows = lookup_join(
        tables.appointments, billed, "client_id", "left", spread_by=["appointment_id"], bound=tables.clients
    )
    hit = (F.col("_billed") == 1) & (F.col("invoiced") == 0) & F.col("status").isin(BILLABLE_STATUSES)
    return rows.withColumns({
        "updated_at": F.when(hit, times.local_literal(as_of)).otherwise(F.col("updated_at")),
        "invoiced": F.when(hit, 1).otherwise(F.col("invoiced")),
    }).select(*tables.appointments.columns)


def apply_invoice_run(tables: Tables, as_of: dt.datetime, client_ids: DataFrame | None = None) -> Tables:
    """Append the run's invoices and their lines, and flag what they bill.

    Every line becomes a row of ``invoice_lines``; the invoice carries the JSON of its first part.
    """
    headers = materialized(invoice_run(tables, as_of, client_ids), "invoice-run")
    lines = materialized(run_lines(tables, headers), "invoice-lines")
    first = line_documents(lines.where(F.col("line_no") <= LINES_PER_DOCUMENT)).select("invoice_id", "line_items")
    rows = headers.join(first, "invoice_id", "left").withColumns({
        "paid": F.lit(0), "created_at": times.local_literal(as_of),
    })
    return tables.replace(
        invoices=tables.invoices.unionByName(conform(rows, "invoices")),
        invoice_lines=tables.invoice_lines.unionByName(lines),
        appointments=mark_invoiced(tables, headers, as_of),
    )


def unbilled_but_invoiced(tables: Tables) -> DataFrame:
    """Rows flagged as invoiced while billing nothing at the time: a fee added
    later would never reach an invoice."""
    return priced(tables.appointments.where(
        (F.col("invoiced") == 1) & F.col("status").isin(BILLABLE_STATUSES)
    )).where(F.col("billable_total") <= 0).select("appointment_id", "appointment_no", "client_id", "status")


def mark_invoices_sent(tables: Tables, numbers: DataFrame, as_of: dt.datetime) -> Tables:
    marks = numbers.select("invoice_number").distinct().withColumn("sent_date", times.date_literal(as_of.date()))
    return tables.replace(invoices=apply_changes(tables.invoices, marks, "invoice_number"))


def mark_invoices_paid(tables: Tables, numbers: DataFrame, as_of: dt.datetime) -> Tables:
    marks = numbers.select("invoice_number").distinct().withColumns({
        "paid": F.lit(1), "paid_date": times.date_literal(as_of.date()),
    })
    return tables.replace(invoices=apply_changes(tables.invoices, marks, "invoice_number"))
