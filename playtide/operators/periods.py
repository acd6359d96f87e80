"""Named periods of the local calendar (days since 1970-01-01, both ends included)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days before the latest day with data, by period.
BACK = {"last_4_weeks": 27, "last_6_months": 182}


def bounds(events: DataFrame, period: str, today: Column | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: first_day, last_day.  ``today`` is a day number (default: the clock's); an unknown period without days is the lifetime."""
    data = events.agg(F.min("day").alias("_low"), F.max("day").alias("_high"))
    now = F.unix_date(F.current_date()).cast("long") if today is None else today
    low, high = F.col("_low"), F.col("_high")
    if period in BACK:
        first, last = high - BACK[period], high
    elif period == "today":
        first, last = now, now
    elif period == "this_week":  # from Monday; day 0 was a Thursday
        first, last = now - F.pmod(now + 3, F.lit(7)), now
    elif period == "this_year":
        first, last = F.unix_date(F.trunc(F.date_from_unix_date(now.cast("int")), "year")).cast("long"), now
    elif period == "custom":
        first, last = F.lit(start).cast("long"), F.lit(end).cast("long")
    else:
        first, last = low, high
    return data.select(first.alias("first_day"), last.alias("last_day"))


def within(frame: DataFrame, span: DataFrame) -> DataFrame:
    """The rows of ``frame`` (with day) in the period; open where a bound is null.

    Events and slices are filtered each by their own day, so a session over midnight keeps
    the part that lies inside: slice the unfiltered timeline first, filter after.
    """
    inside = (F.col("first_day").isNull() | (F.col("day") >= F.col("first_day"))) & (F.col("last_day").isNull() | (F.col("day") <= F.col("last_day")))
    return frame.join(F.broadcast(span), inside).drop("first_day", "last_day")
