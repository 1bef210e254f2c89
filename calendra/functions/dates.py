"""Date column expressions: weekday positions, recurrence filters, free-street days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal_in_month(d: Column) -> Column:
    """1 for the first such weekday of the month, 2 for the second, …"""
    return F.ceil(F.dayofmonth(d) / F.lit(7.0)).cast("int")


def is_last_in_month(d: Column) -> Column:
    return F.month(F.date_add(d, 7)) != F.month(d)


def year_days(year: Column) -> Column:
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.sequence(first, F.make_date(year, F.lit(12), F.lit(31)))


def recurs_on(d: Column, weekdays: Column, months: Column, ordinals: Column) -> Column:
    """Whether a date is on the weekdays (Mon=0), months and ordinals given; -1 is the last."""
    nth = F.array_contains(ordinals, ordinal_in_month(d))
    last = F.array_contains(ordinals, F.lit(-1)) & is_last_in_month(d)
    return (
        F.array_contains(weekdays, F.weekday(d))
        & F.array_contains(months, F.month(d))
        & (nth | last)
    )


def free_street_day(d: Column) -> Column:
    """First Monday of March, May, July, September and November."""
    month = F.month(d)
    return (month % 2 == 1) & (month != 1) & (F.dayofmonth(d) <= 7) & (F.weekday(d) == 0)


def parse_ymd(text: Column) -> Column:
    """Strict ``YYYY-MM-DD``; anything else, or an impossible day, is null."""
    return F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")
    )


def rome_time(ts_utc: Column) -> Column:
    """UTC instant without zone to Rome civil time, independent of the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/Rome"), ts_utc)
