"""Calendar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(c: Column) -> Column:
    """First day of the month as a date, also for timestamps without a zone."""
    return F.trunc(c.cast("date"), "MM")


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Month borders between two dates (31 January to 1 February is 1)."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def week_ending_sunday(c: Column) -> Column:
    """The Sunday on or after a date."""
    return F.next_day(F.date_sub(c.cast("date"), 1), "SUN")


def relative_week(c: Column, start: str) -> Column:
    """Week number relative to a date; days before it have negative weeks."""
    return F.floor(F.datediff(c.cast("date"), F.lit(start).cast("date")) / 7)


def calendar(c: Column) -> dict[str, Column]:
    """The usual calendar features of a date: weekday 0 is Monday, weeks are ISO weeks."""
    d = c.cast("date")
    return {
        "day_of_week": F.weekday(d),
        "is_weekend": F.weekday(d) >= 5,
        "month": F.month(d),
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
        "year_month": F.date_format(d, "yyyy-MM"),
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": F.last_day(d) == d,
        "dow_sin": F.sin(F.lit(2 * math.pi) * F.weekday(d) / 7),
        "dow_cos": F.cos(F.lit(2 * math.pi) * F.weekday(d) / 7),
        "month_sin": F.sin(F.lit(2 * math.pi) * F.month(d) / 12),
        "month_cos": F.cos(F.lit(2 * math.pi) * F.month(d) / 12),
    }


def _nth(year: Column, month: int, weekday: str, nth: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (nth - 1))


def us_federal_holiday(c: Column) -> Column:
    """Whether a date is a United States federal holiday by its rule (not the observed substitute day)."""
    d, y = c.cast("date"), F.year(c.cast("date"))
    fixed = F.date_format(d, "MM-dd").isin("01-01", "06-19", "07-04", "11-11", "12-25")
    may31 = F.make_date(y, F.lit(5), F.lit(31))
    memorial = F.next_day(F.date_sub(may31, 7), "MON")
    moving = [
        _nth(y, 1, "MON", 3), _nth(y, 2, "MON", 3), memorial, _nth(y, 9, "MON", 1), _nth(y, 10, "MON", 2), _nth(y, 11, "THU", 4),
    ]
    out = fixed
    for m in moving:
        out = out | (d == m)
    return out


# Holidays of states beside the federal ones, as month and day.
STATE_HOLIDAYS = {"IL": ("02-12",)}


def state_holiday(c: Column, state: str) -> Column:
    """Whether a date is a fixed holiday of the state that is no federal one."""
    return F.date_format(c.cast("date"), "MM-dd").isin(*STATE_HOLIDAYS[state])
