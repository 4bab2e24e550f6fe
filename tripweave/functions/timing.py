"""Time expressions; none depends on the session's time zone."""

from __future__ import annotations

import datetime
import math
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F


def epoch_to_timestamp(tst) -> Column:
    return F.timestamp_seconds(tst if isinstance(tst, Column) else F.col(tst))


def to_local(timestamp, tz) -> Column:
    """Instant to naive local time in a per-row zone."""
    zone = tz if isinstance(tz, Column) else F.col(tz)
    return F.convert_timezone(F.lit("UTC"), zone, utc_clock(timestamp))


def utc_clock(timestamp) -> Column:
    """Instant to the naive time that a UTC clock shows."""
    ts = timestamp if isinstance(timestamp, Column) else F.col(timestamp)
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def display_time(timestamp, tz: str) -> Column:
    """UTC instant as seen in the viewer's zone."""
    return to_local(timestamp, F.lit(tz))


def cyclical_hour(timestamp) -> tuple[Column, Column]:
    angle = F.hour(timestamp) * F.lit(2 * math.pi) / 24
    return F.sin(angle), F.cos(angle)


def departure_decimal(local_time) -> Column:
    """Hour of day with minutes as a fraction, two decimals."""
    ts = local_time if isinstance(local_time, Column) else F.col(local_time)
    return F.round(F.hour(ts) + F.minute(ts) / F.lit(60.0), 2)


def day_name(local_time) -> Column:
    """Mon..Sun; '?' when the time is missing."""
    ts = local_time if isinstance(local_time, Column) else F.col(local_time)
    return F.coalesce(F.date_format(ts, "EEE"), F.lit("?"))


def day_bounds_utc(day, tz: str, end: bool = False) -> Column:
    """Unix seconds of a local day's first (or last) second in ``tz``, as a constant."""
    clock = f"{day} 23:59:59" if end else f"{day} 00:00:00"
    return F.lit(int(datetime.datetime.fromisoformat(clock).replace(tzinfo=ZoneInfo(tz)).timestamp()))


def minutes_between(start, end) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)
