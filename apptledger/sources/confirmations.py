"""Booking confirmations: fields out of free text, and input put in house form.

Three message shapes are understood: a dash-separated order, a title office's
note with a file number, and a comma-separated order. What a message does not
say stays NULL and is listed in ``missing_fields``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptledger.functions import naming, times
from apptledger.model import MONEY

# What people say and the value it stands for.
SYNONYMS = {
    "client_type": {"escrow company": "title_escrow", "title company": "title_escrow"},
    "signing_type": {"refi": "refinance", "loan mod": "loan_mod"},
}

MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

ORDER_REF = r"\b(?:[Oo]rder|[Ff]ile)\s+([A-Z0-9][A-Z0-9-]*)"
SIGNING_TYPE = (
    r"(?i)\b(purchase|refinance|refi|seller|heloc|reverse|loan mod|gnw|apostille|hospital|jail|other)\b"
)
PHONE = r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})"
NAMED_DATE = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(\d{1,2})(?:,\s*(\d{4}))?"
SLASH_DATE = r"\b(\d{1,2})/(\d{1,2})\b(?:/(\d{4}))?"
# 2:10 pm, 2:10 p.m., 14:10; and noon.
CLOCK = r"(?i:\b(?:(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\b|([01]?\d|2[0-3]):([0-5]\d)\b|(noon)\b))"
# The start stands next to the date; a clock after "by" is a deadline.
STARTS = "(?:" + NAMED_DATE + "|" + SLASH_DATE + r")[\s,@–—-]*(?:at\s+)?" + CLOCK
DEADLINE = r"\b[Bb]y\s+" + CLOCK
# Short forms of street endings.
STREET_ENDINGS = "Aly|Ave|Blvd|Cir|Ct|Dr|Hwy|Ln|Loop|Pkwy|Pl|Plz|Rd|Row|Run|Sq|St|Ter|Trl|Way|Xing"
STREET = (
    r"\b(\d+ (?:[A-Za-z0-9]+ ){1,3}?(?:" + STREET_ENDINGS
    + r")\b(?: [NSEW]{1,2}\b)?(?:,? (?:#\s?|(?:Apt|Unit|Ste|Suite)\.? )[\w-]+)?)"
)
ZIP = r"(?<![\d-])(\d{5})(?![\d-])"
AMOUNT = r"\$(\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d+(?:\.\d{2})?)"
SIGNING_FEE = AMOUNT
PRINT_FEE = r"\+\s*" + AMOUNT + r"\s*print"
SCANBACKS = r"(?i)\b(?:no\s+)?scan-?backs?\b"
THEY_PRINT = r"(?i)\bthey print\b"
DROP = r"\b(FedEx|UPS)\b(?:\s+drop)?\s+" + DEADLINE
# Names in any alphabet, with initials, apostrophes and hyphens.
NAME = r"\p{Lu}(?:\.|[\p{L}\p{M}'’]+(?:-[\p{L}\p{M}'’]+)*)?"
PERSON = NAME + "(?: " + NAME + ")+"
SIGNER = r"(?:[Ss]igning party:?|[Bb]orrowers?:?|[Ss]ellers?|[Ss]igners?:?|meet) (" + PERSON + r"(?: and " + PERSON + r")*)"
TOWN = STREET + r",? ([A-Z][A-Za-z.' -]*?)(?:, ([A-Z]{2}))?,? \d{5}\b"
CLIENT = r"^(.+?)\s+(?:emailed|order)\b"

REQUIRED_FIELDS = ["order_ref", "signing_type", "scheduled_start", "street", "zip", "signing_fee", "signer_name"]


def mention(text: Column | str, pattern: str) -> Column:
    """The whole first match, NULL when there is none. Groups are then taken from
    this short piece, so the message itself is searched once per pattern."""
    return F.regexp_substr(times.col(text), F.lit(pattern))


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(times.col(text), pattern, group), F.lit(""))


def amount(text: Column, pattern: str) -> Column:
    """A dollar amount, its thousands set apart by commas or not."""
    return F.replace(found(text, pattern), F.lit(","), F.lit("")).try_cast(MONEY)


def canonical(field: str, said: Column | str) -> Column:
    """The house value for what was said; values already in house form pass."""
    said = F.trim(F.lower(times.col(said)))
    return F.coalesce(F.try_element_at(naming.literal_map(SYNONYMS[field]), said), said)


def clock_minutes(text: Column | str) -> Column:
    """Minutes after midnight of a clock time."""
    hour = found(text, CLOCK, 1).cast("int")
    minute = F.coalesce(found(text, CLOCK, 2), F.lit("0")).cast("int")
    afternoon = F.lower(found(text, CLOCK, 3)) == "p"
    return F.coalesce(
        (hour % 12 + F.when(afternoon, 12).otherwise(0)) * 60 + minute,
        found(text, CLOCK, 4).cast("int") * 60 + found(text, CLOCK, 5).cast("int"),
        F.when(found(text, CLOCK, 6).isNotNull(), 12 * 60))


def start_mention(text: Column | str) -> Column:
    """The piece that tells the start: a date with the clock after it, else the first clock that is no deadline."""
    text = times.col(text)
    return F.coalesce(mention(text, STARTS), mention(F.regexp_replace(text, DEADLINE, ""), CLOCK))


def start_clock(text: Column | str) -> Column:
    """``10am`` as ``T10:00``."""
    minutes = clock_minutes(text)
    return F.when(minutes.isNotNull(), F.format_string(
        "T%02d:%02d", F.floor(minutes / F.lit(60)), minutes.cast("bigint") % 60
    ))


def without_offset(text: Column | str) -> Column:
    """Start text with a trailing ``Z`` or offset removed."""
    return F.regexp_replace(times.col(text), r"(T\d{2}:\d{2}(?::\d{2})?)(?:Z|[+-]\d{2}:?\d{2})$", "$1")


def mentioned_date(named: Column, slashed: Column, default_year: int) -> Column:
    """The date of a ``Sep 8, 2026`` mention, else of a ``9/8`` one."""
    month = F.coalesce(
        F.try_element_at(naming.literal_map(MONTHS), F.lower(found(named, NAMED_DATE, 1))),
        F.lpad(found(slashed, SLASH_DATE, 1), 2, "0"),
    )
    day = F.lpad(F.coalesce(found(named, NAMED_DATE, 2), found(slashed, SLASH_DATE, 2)), 2, "0")
    year = F.coalesce(found(named, NAMED_DATE, 3), found(slashed, SLASH_DATE, 3), F.lit(str(default_year)))
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


# One search of the message per pattern.
MENTIONS = {
    "client": CLIENT, "order": ORDER_REF, "type": SIGNING_TYPE, "phone": PHONE, "named_date": NAMED_DATE,
    "slash_date": SLASH_DATE, "street": STREET, "zip": ZIP, "fee": SIGNING_FEE, "print": PRINT_FEE,
    "scanbacks": SCANBACKS, "drop": DROP, "they_print": THEY_PRINT, "signer": SIGNER, "town": TOWN,
}


def extract_confirmations(messages: DataFrame, default_year: int, text: str = "text") -> DataFrame:
    """One row of fields per message. Loan numbers are never picked up."""
    said = messages.withColumn("_m", F.struct(*[
        mention(text, pattern).alias(name) for name, pattern in MENTIONS.items()
    ], start_mention(text).alias("clock"))).drop(text)

    def piece(name: str) -> Column:
        return F.col(f"_m.{name}")

    dated = said.withColumn(
        "_day", mentioned_date(piece("named_date"), piece("slash_date"), default_year).cast("timestamp_ntz")
    )
    fields = dated.withColumns({
        "client_name": found(piece("client"), CLIENT),
        "order_ref": found(piece("order"), ORDER_REF),
        "signing_type": canonical("signing_type", piece("type")),
        "phone": F.regexp_replace(piece("phone"), PHONE, "$1-$2-$3"),
        "scheduled_start": times.plus_minutes("_day", clock_minutes(piece("clock"))),
        "street": piece("street"),
        "city": found(piece("town"), TOWN, 2),
        "state": found(piece("town"), TOWN, 3),
        "zip": piece("zip"),
        "signer_name": found(piece("signer"), SIGNER),
        "signer_count": F.size(F.split(found(piece("signer"), SIGNER), " and ")).cast("bigint"),
        "signing_fee": amount(piece("fee"), SIGNING_FEE),
        "print_fee": F.when(piece("they_print").isNotNull(), F.lit(0).cast(MONEY))
        .otherwise(amount(piece("print"), PRINT_FEE)),
        "scanbacks_required": F.when(F.lower(piece("scanbacks")).startswith("no"), 0)
        .when(piece("scanbacks").isNotNull(), 1),
        "shipping_carrier": found(piece("drop"), DROP),
        "drop_deadline": times.plus_minutes("_day", clock_minutes(piece("drop"))),
    })
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS]))
    return fields.withColumn("missing_fields", missing).drop("_m", "_day")
