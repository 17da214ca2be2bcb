"""Scalar column functions shared by the operators: geometry, number and time parsing, usable times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000

#: ISO 8601 date, optionally a time with an offset; a time without one is UTC.
_ISO = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def speed_kph(lat1, lon1, t1, lat2, lon2, t2) -> Column:
    """Implied speed; Infinity for equal times and NaN for a step back, null without a first point."""
    dt = t2 - t1
    return (
        F.when(dt == 0, F.lit(float("inf")))
        .when(dt < 0, F.lit(float("nan")))
        .when(dt > 0, haversine_m(lat1, lon1, lat2, lon2) / F.when(dt > 0, dt) * F.lit(3600.0))
    )


def scaled_round(x: Column, digits: int) -> Column:
    """x to so many digits as DuckDB does it: the scaled double is rounded. F.round reads the decimal digits of x, so 0.75 / (5 / 3), a hair below 0.45, would become 0.4 and not 0.5."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def leading_number(text: str | Column) -> Column:
    """The number that a text starts with, as a double; null if it starts with none."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    endless = F.regexp_extract(text, r"^\s*([+-]?)Infinity", 0)
    return F.when(number != "", number.try_cast("double")).when(endless != "", F.trim(endless).try_cast("double"))


def iso_millis(text: str | Column) -> Column:
    """Milliseconds since the epoch of an ISO 8601 text, null for anything else. The session's time zone must be UTC."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.when(text.rlike(_ISO), F.unix_millis(F.try_to_timestamp(text)))


def usable(time: str | Column) -> Column:
    """A time that correction works with: known and positive."""
    time = F.col(time) if isinstance(time, str) else time
    return F.coalesce(time > 0, F.lit(False))


def same_utc_day(a: Column, b: Column) -> Column:
    return F.floor(a / MS_PER_DAY) == F.floor(b / MS_PER_DAY)


def text_or_null(text: str | Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
