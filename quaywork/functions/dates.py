"""Calendar-day expressions; days have no time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_day(text: Column) -> Column:
    """A struct (value date, code string) of a YYYY-MM-DD text from 2000 to 2100.

    code: INVALID_DATE for another form or no real day, OUT_OF_RANGE for another year; years 0 to 99 are no real days.
    """
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    # casts, for a parser with a pattern throws and catches at every text that is no day
    day = F.when(shaped, text.try_cast("date"))
    year = F.year(day)
    code = F.when(day.isNull() | (year < 100), "INVALID_DATE").when(~year.between(2000, 2100), "OUT_OF_RANGE")
    return F.struct(F.when(code.isNull(), day).alias("value"), code.alias("code"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_text(day: Column) -> Column:
    """``Mar 4, 2026``; a dash for null."""
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit("—"))


def months(first: Column, last: Column) -> Column:
    """First days of all months from one to the other."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
