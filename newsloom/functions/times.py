"""Column functions on dates and times; nothing reads the clock, "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(x: Column, fallback: Column) -> Column:
    """ISO 8601, with ``Z`` or an offset or none; what can't be read is the fallback."""
    return F.coalesce(F.try_to_timestamp(x), fallback)


def parse_epoch_or_iso(x: Column, fallback: Column) -> Column:
    """Digits are seconds since 1970."""
    digits = F.regexp_like(x, F.lit(r"^\d+$"))
    return F.when(digits, F.timestamp_seconds(x.try_cast("bigint"))).otherwise(parse_iso(x, fallback))


def parse_rfc822(x: Column, fallback: Column) -> Column:
    """``Mon, 01 Jan 2024 10:00:00 GMT``."""
    return F.coalesce(F.try_to_timestamp(F.substring(x, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z")), fallback)


def parse_day(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))


def rfc3339(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative_time(then: Column, now: Column) -> Column:
    """``just now`` below a minute, minutes below an hour, hours below a day, else days."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )
