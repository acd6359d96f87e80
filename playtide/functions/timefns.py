"""Local calendar parts as integer arithmetic on microseconds since 1970 (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playtide.config import LOCAL_SHIFT_US, US_PER_DAY, US_PER_HOUR


def _floor_div(a: Column, b: int) -> Column:
    """Exact integer quotient, rounded down, of a long by a positive constant."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of an un-zoned timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def local_hour_no(us: Column) -> Column:
    """Number of the local hour since 1970."""
    return _floor_div(us + LOCAL_SHIFT_US, US_PER_HOUR)


def local_day_no(us: Column) -> Column:
    return _floor_div(us + LOCAL_SHIFT_US, US_PER_DAY)


def dow(day_no: Column) -> Column:
    """Day of the week, Monday 0; 1970-01-01 was a Thursday."""
    return F.pmod(day_no + 3, F.lit(7))


def week_no(us: Column, start_dow: int = 0, start_hour: int = 0) -> Column:
    """Day number on which the chart week of a moment starts."""
    day = _floor_div(us + (LOCAL_SHIFT_US - start_hour * US_PER_HOUR), US_PER_DAY)
    return day - F.pmod(day + (3 - start_dow), F.lit(7))


def as_date(day_no: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_no.cast("int"))


def classify_platform(raw: Column) -> Column:
    """Ordered substring rules; empty or null is unknown."""
    low = F.lower(F.trim(raw))
    has = lambda *xs: F.lit(False) if not xs else low.contains(xs[0]) | has(*xs[1:])
    return (
        F.when(raw.isNull() | (low == ""), "unknown").when(has("ios"), "ios").when(has("osx", "mac"), "macos")
        .when(has("windows", "win"), "windows").when(has("android"), "android").when(has("web", "browser"), "web").otherwise("other")
    )
