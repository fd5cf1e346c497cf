"""The two JSON feeds: completion records and shift status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shape of a completion record export.
SUBMISSION = T.StructType([
    T.StructField("submission_id", T.LongType()),
    T.StructField("worker_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("submitted_at", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("outcome", T.StringType()),
        T.StructField("docs_notarized", T.IntegerType()),
        T.StructField("id_types", T.ArrayType(T.StringType())),
        T.StructField("scanbacks", T.StringType()),
        T.StructField("tracking_no", T.StringType()),
        T.StructField("issues", T.StringType()),
        T.StructField("no_sign_details", T.StringType()),
    ])),
    T.StructField("media", T.ArrayType(T.StructType([
        T.StructField("field", T.StringType()),
        T.StructField("cdn_url", T.StringType()),
    ]))),
])

# The shape of a shift status reply.
SHIFT_STATUS = T.StructType([
    T.StructField("shift_id", T.LongType()),
    T.StructField("worker_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("actual_in", T.StringType()),
    T.StructField("actual_out", T.StringType()),
    T.StructField("punches", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("gps_verified", T.BooleanType()),
        T.StructField("distance_from_site_m", T.IntegerType()),
    ]))),
])

RECEIPT_FIELD = "drop_receipt"


def _parsed(raw: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """The fields of every body; ``broken`` holds the text of one that did not parse.

    Going through a one-element array keeps the optimizer from repeating the parse
    for each field and filter that uses it.
    """
    with_broken = T.StructType([*schema.fields, T.StructField("broken", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return raw.select(F.inline(F.array(F.from_json(body, with_broken, options))))


def read_submissions(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Completion records from export bodies, one or many per body, and the bodies
    that could not be read. Identity document types are not carried on."""
    export = T.StructType([T.StructField("submissions", T.ArrayType(SUBMISSION))])
    parsed = _parsed(raw, body, export)
    rows = parsed.where(F.col("broken").isNull()).select(F.explode("submissions").alias("s"))
    receipts = F.size(F.filter(F.coalesce("s.media", F.array()), lambda m: m["field"] == RECEIPT_FIELD))
    records = rows.select(
        "s.submission_id", "s.worker_id", F.col("s.event_id").alias("event_ext_id"),
        F.col("s.submitted_at").try_cast("timestamp_ntz").alias("submitted_at"),
        "s.data.outcome", "s.data.docs_notarized", "s.data.scanbacks", "s.data.tracking_no", "s.data.issues",
        "s.data.no_sign_details", receipts.alias("drop_receipts"),
    )
    return records, parsed.where(F.col("broken").isNotNull()).select("broken")


def read_shift_status(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Shifts with their stamps, the first check-in punch and the punch count, and
    the bodies that could not be read."""
    parsed = _parsed(raw, body, SHIFT_STATUS)
    punches = F.coalesce("punches", F.array())
    first_in = F.try_element_at(F.filter(punches, lambda p: p["type"] == "in"), F.lit(1))
    shifts = parsed.where(F.col("broken").isNull()).select(
        "shift_id", "worker_id", "status",
        F.col("actual_in").try_cast("timestamp").alias("actual_in"),
        F.col("actual_out").try_cast("timestamp").alias("actual_out"),
        F.substring("actual_in", 1, 10).try_cast("date").alias("work_date"),
        first_in["gps_verified"].cast("int").alias("gps_verified"),
        first_in["distance_from_site_m"].alias("checkin_distance_m"),
        F.size(punches).alias("punch_count"),
        punches.alias("punches"),
    )
    return shifts, parsed.where(F.col("broken").isNotNull()).select("broken")


def explode_punches(shifts: DataFrame) -> DataFrame:
    """One row per punch."""
    return shifts.select("shift_id", "worker_id", F.inline("punches"))
