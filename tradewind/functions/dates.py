"""Months and day counts on zone-less timestamps."""

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ts: Column) -> Column:
    """First day of the month: a four-byte grouping key, formatted only after grouping."""
    return F.trunc(F.to_date(ts), "MM")


def month_label(day: Column) -> Column:
    """``YYYY-MM`` text; null stays null."""
    return F.date_format(day, "yyyy-MM")


def month_of(ds: str) -> str:
    """The ``YYYY-MM`` prefix of a date string such as ``2017-03-01``."""
    month = ds[:7]
    _first_day(month)
    return month


def in_month(ts: Column, month: str) -> Column:
    """``ts`` lies in ``month`` ("YYYY-MM"), as a half-open range a scan can use."""
    first = _first_day(month)
    after = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return (ts >= _midnight(first)) & (ts < _midnight(after))


def not_in_month(ts: Column, month: str) -> Column:
    """Complement of ``in_month`` that keeps rows without a time."""
    return ~in_month(ts, month) | ts.isNull()


def days_between(start: Column, end: Column, whole_days: bool = False) -> Column:
    """Days from start to end: calendar boundaries crossed, or whole 24-hour spans."""
    if whole_days:
        return F.timestamp_diff("DAY", start, end).cast("bigint")
    return F.datediff(end, start).cast("bigint")


def _first_day(month: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        raise ValueError(f"month must look like 2017-03, not {month!r}")
    return date(int(month[:4]), int(month[5:]), 1)


def _midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")
