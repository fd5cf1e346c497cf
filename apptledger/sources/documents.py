"""Plain-text invoices, reminders, payout statements and no-show notes.

Texts are built a document at a time, and a document holds a bounded number of
lines (see ``operators.billing``), so no single row grows with a client.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.functions import money, times
from apptledger.model import Tables
from apptledger.operators.billing import (
    LINE_ITEM,
    document_part,
    further_lines,
    line_documents,
    lines_of,
    numbered_lines,
)
from apptledger.operators.joins import lookup_join
from apptledger.plans.views import no_show_evidence, payouts_due
from apptledger.settings import setting


def dollars(amount: Column | str) -> Column:
    return F.concat(F.lit("$"), times.col(amount).cast("decimal(22,2)").cast("string"))


def local_clock(instant: Column | str, offset: Column) -> Column:
    """``HH:MM`` of an instant in the business's fixed offset."""
    minutes = F.pmod(F.unix_seconds(times.col(instant)) + times.offset_seconds(offset), F.lit(86400))
    hour, minute = F.floor(minutes / F.lit(3600)), F.floor(minutes % 3600 / F.lit(60))
    return F.format_string("%02d:%02d", hour, minute)


def _document(texts: str) -> Column:
    return F.array_join(F.transform(texts, lambda x: x["text"]), "\n")


def fee_breakdown() -> Column:
    """The fees behind a line, leaving out those that are zero."""
    def fee(label: str, name: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.lit(f"{label} "), dollars(name)))

    return (
        F.when(F.col("status") == "completed", F.concat_ws(
            " + ", fee("signing", "signing_fee"), fee("print", "print_fee"),
            fee("trip", "trip_fee"), fee("other", "other_fee")))
        .when(F.col("status") == "no_show", F.concat_ws(" + ", fee("trip", "trip_fee"), fee("no-sign", "no_sign_fee")))
        .otherwise(F.concat_ws(" + ", fee("other", "other_fee")))
    )


def invoice_line_text(offset: Column) -> Column:
    order = F.coalesce(F.concat(F.lit(", order "), F.col("client_order_ref")), F.lit(""))
    arrival = F.when(
        (F.col("gps_verified") == 1) & F.col("checked_in_at").isNotNull(),
        F.concat(F.lit("; GPS-verified arrival "), local_clock("checked_in_at", offset)),
    )
    no_show = F.when(
        F.col("status") == "no_show",
        F.concat(F.lit(" (Trip / no-sign fee - signer did not appear"), F.coalesce(arrival, F.lit("")), F.lit(")")),
    )
    return F.concat(
        F.lit("  "), F.col("appointment_no"), F.lit("  "), F.col("appointment_date").cast("string"), F.lit("  "),
        F.col("signing_type"), order, F.lit("  "), fee_breakdown(), F.coalesce(no_show, F.lit("")),
        F.lit("  "), dollars("billable_total"),
    )


def render_invoices(tables: Tables, headers: DataFrame) -> DataFrame:
    """One text per invoice document, before a run is applied and after. The head and total repeat on every part."""
    offset = setting(tables.settings, "timezone_offset")
    lines = lines_of(tables, headers).withColumns({"text": invoice_line_text(offset), "part_no": document_part()})
    documents = lines.groupBy("invoice_id", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("texts")
    )
    heads = headers.join(tables.clients.select("client_id", "client_name", "billing_email"), "client_id").select(
        "invoice_id", "invoice_number", "invoice_date", "due_date", "payment_terms_days", "total_amount",
        "client_name", "billing_email",
    )
    rows = lookup_join(documents, heads, "invoice_id", spread_by=["part_no"], bound=headers)
    address = F.coalesce(F.concat(F.lit(" ("), F.col("billing_email"), F.lit(")")), F.lit(""))
    head = F.concat_ws(
        "\n",
        setting(tables.settings, "business_name"),
        F.concat(F.lit("Invoice "), F.coalesce("invoice_number", F.lit(""))),
        F.concat(F.lit("To: "), F.col("client_name"), address),
        F.concat(
            F.lit("Date: "), F.col("invoice_date").cast("string"), F.lit("    Due: "), F.col("due_date").cast("string"),
            F.lit(" (net "), F.col("payment_terms_days").cast("string"), F.lit(")"),
        ),
    )
    text = F.concat(head, F.lit("\n\n"), _document("texts"), F.lit("\n\nTotal due: "), dollars("total_amount"))
    return rows.select("invoice_id", "invoice_number", "part_no", text.alias("text"))


def render_statements(tables: Tables) -> DataFrame:
    """Open payouts per worker, split like invoices when a worker has very many."""
    rows = numbered_lines(payouts_due(tables), "notary_id")
    amount = F.coalesce(dollars("amount"), F.lit("amount needed"))
    line = F.concat_ws(
        "  ", F.lit(""), F.col("appointment_no"), F.col("appointment_date").cast("string"), F.col("signing_type"), amount
    )
    documents = (
        rows.withColumn("text", line)
        .groupBy("notary_id", "notary_name", "notary_total_due", "part_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("texts"))
    )
    text = F.concat(
        F.lit("Statement for "), F.col("notary_name"), F.lit("\n"), _document("texts"),
        F.lit("\nTotal: "), dollars(F.coalesce("notary_total_due", F.lit(0).cast("decimal(22,2)"))),
    )
    return documents.select("notary_id", "part_no", text.alias("text"))


def render_no_show_notes(tables: Tables) -> DataFrame:
    """The note that asks for the trip fee, one per no-show."""
    offset = setting(tables.settings, "timezone_offset")
    near = F.when(F.col("gps_verified") == 1, F.concat(
        F.lit(", GPS-verified "), F.col("checkin_distance_m").cast("string"), F.lit(" m from the address")
    ))
    stayed = F.when(F.col("minutes_on_site").isNotNull(), F.concat(
        F.lit("; on site "), F.col("minutes_on_site").cast("string"), F.lit(" minutes, left "),
        local_clock("checked_out_at", offset),
    ))
    arrived = F.when(F.col("checked_in_at").isNotNull(), F.concat(
        F.lit("Arrived "), local_clock("checked_in_at", offset), F.coalesce(near, F.lit("")),
        F.coalesce(stayed, F.lit("")), F.lit("."),
    ))
    subject = F.coalesce(F.concat(F.lit("Order "), F.col("client_order_ref")), F.col("appointment_no"))
    when = F.replace(F.substring(times.local_text("scheduled_start"), 1, 16), F.lit("T"), F.lit(" "))
    text = F.concat_ws(
        "\n",
        F.concat(subject, F.lit(": no signing at the appointment of "), when, F.lit(".")),
        arrived,
        F.concat(F.lit("Fees owed: trip "), dollars("trip_fee"), F.lit(", no-sign "), dollars("no_sign_fee"),
                 F.lit(". Our number: "), F.col("appointment_no"), F.lit(".")),
        F.concat(F.lit("Record: "), F.col("notes")),
    )
    return no_show_evidence(tables).select("appointment_id", "appointment_no", text.alias("text"))


def render_reminders(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """A short message per late invoice, with the order references of its lines.

    The references come from the JSON on the row, so nothing is shuffled for them.
    The further parts of long invoices, made of their stored lines, get a message each.
    """
    today = as_of.date()
    late = tables.invoices.where((F.col("paid") == 0) & (F.col("due_date") < times.date_literal(today)))
    more = line_documents(further_lines(tables.invoice_lines)).select(
        "invoice_id", F.col("line_items").alias("_further"))
    further = lookup_join(more, late, "invoice_id", spread_by=["_further"], bound=tables.invoices)
    late = late.unionByName(further.withColumn("line_items", F.col("_further")).select(*late.columns))
    clients = tables.clients.select("client_id", "client_name", "billing_email")
    rows = lookup_join(late, clients, "client_id", spread_by=["invoice_id"])
    items = F.from_json("line_items", T.ArrayType(LINE_ITEM))
    orders = F.nullif(F.array_join(F.array_compact(F.transform(items, lambda x: x["order_ref"])), ", "), F.lit(""))
    text = F.concat(
        F.lit("Invoice "), F.coalesce("invoice_number", F.lit("")), F.lit(" to "), F.col("client_name"), F.lit(" for "),
        dollars("total_amount"), F.lit(" was due on "), F.col("due_date").cast("string"), F.lit(", "),
        money.days_past_due(today).cast("string"), F.lit(" days ago."),
        F.coalesce(F.concat(F.lit(" Orders: "), orders, F.lit(".")), F.lit("")),
    )
    return rows.select("invoice_id", "client_id", "billing_email", text.alias("text"))


def write_texts(rendered: DataFrame, path: str, by: str) -> None:
    """Write texts as files, in folders named by ``by``."""
    rendered.select(by, "text").hint("rebalance", by).write.partitionBy(by).option("lineSep", "\n\f\n").text(path)
