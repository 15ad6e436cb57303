"""Calendar parts of a date or timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday_name(col) -> Column:
    """Full English day name ('Monday'); Spark's `dayname` gives 'Mon'."""
    return F.date_format(_c(col), "EEEE")


def weekday_number(col) -> Column:
    """Day of week, Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(_c(col))


_PARTS = {
    "hour": F.hour,
    "weekday": weekday_number,
    "day": F.dayofmonth,
    "month": F.month,
    "year": F.year,
}


def calendar_part(col, part: str) -> Column:
    """One calendar part: hour, weekday, day, month or year (INT)."""
    return _PARTS[part](_c(col)).cast("int")
