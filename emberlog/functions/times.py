"""Timestamps: output text, input text, literals, bucket starts."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F, types as T

from emberlog.schema import DAY_MS, ISO_8601

# Bucket widths in microseconds. A day is 24 hours from the
# origin, not a calendar day.
BUCKET_MICROS = {
    "1m": 60_000_000,
    "5m": 300_000_000,
    "1h": 3_600_000_000,
    "1d": 86_400_000_000,
}


def utc_date(timestamp: Column) -> Column:
    """The UTC day, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_millis(timestamp) / F.lit(DAY_MS)).cast("int"))


def utc_midnight(day: Column) -> Column:
    """The start of a UTC day, whatever the session's zone."""
    return F.timestamp_millis(F.unix_date(day).cast("bigint") * DAY_MS)


def iso_text(timestamp: Column) -> Column:
    """UTC text with three fraction digits and a ``Z``, whatever the session's zone."""
    millis = F.pmod(F.unix_millis(timestamp.cast("timestamp")), F.lit(DAY_MS)).cast("int")

    def part(unit: int, count: int, digits: int) -> Column:
        return F.lpad((F.floor(millis / unit) % count).cast("string"), digits, "0")

    return F.concat(
        utc_date(timestamp.cast("timestamp")).cast("string"), F.lit("T"), part(3_600_000, 24, 2),
        F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1_000, 60, 2), F.lit("."),
        part(1, 1_000, 3), F.lit("Z"),
    )


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def text_millis(text: str) -> int | None:
    """Milliseconds of one ISO 8601 argument, by the rules of ``iso_millis``."""
    if not isinstance(text, str) or not re.match(ISO_8601.replace(r"\z", r"\Z"), text, re.ASCII):
        return None
    year, month, day = int(text[:4]), int(text[5:7]), int(text[8:10])
    hour, minute, second = int(text[11:13]), int(text[14:16]), int(text[17:19])
    fraction, zone = re.match(r"(?:\.(\d+))?(.+)", text[19:]).groups()
    fraction = fraction or "0"
    sign = -1 if zone[0] == "-" else 1
    zone_hour, zone_minute = (0, 0) if zone == "Z" else (int(zone[1:3]), int(zone[-2:]))
    midnight = hour == 24 and minute == 0 and second == 0 and not fraction.strip("0")
    if not (1 <= month <= 12 and 1 <= day <= 31 and (hour <= 23 or midnight)):
        return None
    if minute > 59 or second > 59 or zone_hour > 23 or zone_minute > 59:
        return None
    # The calendar repeats every 400 years, which are 146,097 days.
    shift = 0 if year else 146_097
    first = date(year or 400, month, 1).toordinal() - EPOCH.toordinal() - shift
    minutes = hour * 60 + minute - sign * (zone_hour * 60 + zone_minute)
    seconds = (first + day - 1) * 86_400 + minutes * 60 + second
    return seconds * 1_000 + int(fraction[:3].ljust(3, "0"))


def millis_text(millis: int) -> str:
    moment = EPOCH + timedelta(milliseconds=millis)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def millis_literal(millis: int, data_type: T.DataType | None = None) -> Column:
    """A timestamp literal of the column's own type, so comparisons need no cast
    on the column side and still reach the Parquet reader."""
    literal = F.timestamp_millis(F.lit(millis).cast("bigint"))
    return literal.cast("timestamp_ntz") if isinstance(data_type, T.TimestampNTZType) else literal


def day_literal(millis: int) -> Column:
    return F.date_from_unix_date(F.lit(millis // DAY_MS).cast("int"))


def bucket_start_micros(timestamp: Column, origin_millis: int, width_micros: int) -> Column:
    """Start of the fixed-width bucket holding ``timestamp``, aligned to the origin."""
    micros = F.unix_micros(timestamp.cast("timestamp"))
    offset = F.pmod(micros - F.lit(origin_millis * 1_000), F.lit(width_micros))
    return micros - offset


def iso_millis(text: Column) -> Column:
    """Milliseconds since the epoch of an ISO 8601 text, or null.

    The built-in parser reads the usual texts. What it refuses is read field by
    field: a day up to 31 rolls over into the next month, 24:00:00 is the next
    midnight, and offsets reach 23:59. Digits past the milliseconds are cut.
    """
    usual = F.unix_millis(F.try_to_timestamp(text))
    return F.when(text.rlike(ISO_8601), F.coalesce(usual, _millis_by_field(text)))


def _millis_by_field(text: Column) -> Column:
    def number(start: int, length: int) -> Column:
        return F.substring(text, start, length).cast("int")

    year, month, day = number(1, 4), number(6, 2), number(9, 2)
    hour, minute, second = number(12, 2), number(15, 2), number(18, 2)
    fraction = F.regexp_extract(text, r"\.(\d+)", 1)
    millis = F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("int")

    zone = F.regexp_extract(text, r"([+-]\d{2}:?\d{2})\z", 1)
    zone_hour = F.when(zone == "", 0).otherwise(F.substring(zone, 2, 2).cast("int"))
    zone_minute = F.when(zone == "", 0).otherwise(F.substring(zone, -2, 2).cast("int"))
    zone_sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)

    midnight = (hour == 24) & (minute == 0) & (second == 0) & ~fraction.rlike("[1-9]")
    valid = (
        month.between(1, 12)
        & day.between(1, 31)
        & (hour.between(0, 23) | midnight)
        & minute.between(0, 59)
        & second.between(0, 59)
        & zone_hour.between(0, 23)
        & zone_minute.between(0, 59)
    )
    days = F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1
    minutes = hour * 60 + minute - zone_sign * (zone_hour * 60 + zone_minute)
    total = days.cast("bigint") * DAY_MS + (minutes * 60 + second).cast("bigint") * 1_000 + millis
    return F.when(valid, total)
