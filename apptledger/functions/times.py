"""Local wall-clock times (no zone) and instants.

Local times are TIMESTAMP_NTZ. Functions here never route them through the
session time zone, so no result depends on where the cluster runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_literal(when: dt.datetime) -> Column:
    return F.lit(when.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def date_literal(day: dt.date) -> Column:
    return F.lit(day.strftime("%Y-%m-%d")).cast("date")


def local_text(ts: Column | str) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` of a local time."""
    text = col(ts).cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def with_offset(ts: Column | str, offset: Column) -> Column:
    """ISO text of a local time with the business's fixed offset appended."""
    return F.concat(local_text(ts), offset)


def plus_minutes(ts: Column | str, minutes: Column | str | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else col(minutes)
    return F.timestamp_add("MINUTE", minutes, col(ts))


def plus_days(ts: Column | str, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), col(ts))


def local_seconds(ts: Column | str) -> Column:
    """Seconds since the epoch, reading the local time as if it were UTC."""
    ts = col(ts)
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )


def offset_seconds(offset: Column) -> Column:
    """Seconds east of UTC for text such as ``-05:00``."""
    magnitude = F.substring(offset, 2, 2).cast("int") * 3600 + F.substring(offset, 5, 2).cast("int") * 60
    return F.when(offset.startswith("-"), -magnitude).otherwise(magnitude)


def month_key(day: Column | str) -> Column:
    return F.substring(col(day).cast("string"), 1, 7)


def minutes_between(first: Column | str, last: Column | str) -> Column:
    """Nearest whole minute between two instants, NULL unless both are known."""
    seconds = F.unix_seconds(col(last)) - F.unix_seconds(col(first))
    return F.round(seconds.cast("decimal(18,0)") / F.lit(60), 0).cast("int")


def hours_until(deadline: Column | str, as_of: Column) -> Column:
    """Hours to a local deadline, one decimal, negative once it has passed."""
    seconds = local_seconds(deadline) - local_seconds(as_of)
    return (F.round(seconds.cast("decimal(18,0)") / F.lit(360), 0) / F.lit(10)).cast("decimal(12,1)")


def in_local_days(ts: Column | str, first: dt.date, last: dt.date) -> Column:
    """Local date within ``[first, last]``, as a range on the raw column so it
    can reach the scan's statistics."""
    start = dt.datetime.combine(first, dt.time())
    stop = dt.datetime.combine(last + dt.timedelta(days=1), dt.time())
    return (col(ts) >= local_literal(start)) & (col(ts) < local_literal(stop))


def offset_in_seconds(offset: str) -> int:
    """Seconds east of UTC for text such as ``-05:00``."""
    hours, minutes = (int(x) for x in offset[1:].split(":"))
    return (hours * 3600 + minutes * 60) * (-1 if offset[0] == "-" else 1)


def local_time(instant: Column, offset: str) -> Column:
    """The business's wall clock at an instant, whatever the session zone."""
    seconds = F.unix_seconds(instant) + offset_in_seconds(offset)
    midnight = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int")).cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.pmod(seconds, F.lit(86400)).cast("int"), midnight)
