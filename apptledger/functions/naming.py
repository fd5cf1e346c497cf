"""Numbers, keys, labels and normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apptledger.functions.times import col

# Event title by signing type; anything else is generic.
EVENT_TITLES = {
    "purchase": "Purchase signing",
    "refinance": "Refi signing",
    "seller": "Seller signing",
    "heloc": "HELOC signing",
    "reverse": "Reverse mortgage signing",
    "loan_mod": "Loan mod signing",
    "gnw": "General notary work",
    "apostille": "Apostille",
    "hospital": "Hospital signing",
    "jail": "Jail signing",
}
GENERIC_TITLE = "Notary appointment"

# Idempotency key prefix per outbound call.
KEY_PREFIXES = {
    "location": "loc-place-",
    "event": "event-appt-",
    "shift": "shift-appt-",
    "assign": "assign-completion-",
    "cancel": "cancel-shift-",
    "worker": "worker-",
}
FORM_KEY = "form-completion-record"

# Billing status by completion-record outcome key.
STATUS_BY_OUTCOME = {
    "completed": "completed",
    "borrower_no_show": "no_show",
    "signer_refused___declined": "no_show",
    "rescheduled_on_site": "rescheduled",
    "documents_issue___not_signed": "no_show",
    "partial___some_docs_signed": "completed",
}

OPTION_KEY_LENGTH = 30


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def zero_padded(number: Column | str) -> Column:
    """At least four digits; longer numbers are kept whole."""
    return F.format_string("%04d", col(number))


def appointment_number(number: Column | str = "appointment_no") -> Column:
    generated = F.concat(
        F.lit("A-"), F.year("scheduled_start").cast("string"), F.lit("-"), zero_padded("appointment_id")
    )
    return F.coalesce(col(number), generated)


def invoice_number(prefix: Column, has_prefix: Column, number: Column | str | None = None) -> Column:
    """``<prefix>-YYYY-NNNN``. A NULL prefix falls back; an absent one gives no number."""
    generated = F.when(
        has_prefix,
        F.concat(
            F.coalesce(prefix, F.lit("INV")), F.lit("-"),
            F.year("invoice_date").cast("string"), F.lit("-"), zero_padded("invoice_id"),
        ),
    )
    return generated if number is None else F.coalesce(col(number), generated)


def street_address() -> Column:
    """``address[, city][, state][ zip]``; an unknown address gives NULL."""
    def part(separator: str, name: str) -> Column:
        return F.coalesce(F.concat(F.lit(separator), F.col(name)), F.lit(""))

    return F.concat(F.col("address"), part(", ", "city"), part(", ", "state"), part(" ", "zip"))


def outbound_location_name() -> Column:
    return F.coalesce(F.col("place_label"), F.concat(F.lit("Signing "), F.col("appointment_no")))


def outbound_event_title() -> Column:
    title = F.coalesce(F.try_element_at(literal_map(EVENT_TITLES), F.col("signing_type")), F.lit(GENERIC_TITLE))
    return F.concat(title, F.lit(" "), F.col("appointment_no"))


def needs(name: str) -> Column:
    """1 while the outbound counterpart has no external id yet."""
    return F.col(name).isNull().cast("int")


def idempotency_key(kind: str, identity: Column | str, suffix: str = "") -> Column:
    return F.concat(F.lit(KEY_PREFIXES[kind]), col(identity).cast("string"), F.lit(suffix))


def normalized_address(*parts: str) -> Column:
    """Lower case, without ``, . #``, single spaces; missing parts are skipped."""
    joined = F.lower(F.concat_ws(" ", *(parts or ("address", "city", "state", "zip"))))
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[,.#]", ""), r"\s+", " "))


def place_label(client_name: Column | str = "client_name") -> Column:
    """Office: ``client - city``. Home: the street without its house number."""
    street = F.regexp_replace(F.col("address"), r"^\d+\s+", "")
    return F.when(
        F.col("is_repeat_site") == 1, F.concat(col(client_name), F.lit(" - "), F.col("city"))
    ).otherwise(F.concat(F.lit("Signing - "), street))


def option_key(label: Column | str) -> Column:
    """The key a form option gets from its label."""
    return F.substring(F.regexp_replace(F.lower(col(label)), "[^a-z0-9]", "_"), 1, OPTION_KEY_LENGTH)


def status_from_outcome(outcome: Column | str) -> Column:
    return F.try_element_at(literal_map(STATUS_BY_OUTCOME), col(outcome))
