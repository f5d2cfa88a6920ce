"""Calendar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_of_month(day: Column | str) -> Column:
    """1 for the days up to the month's first Sunday, and so on."""
    day = _col(day)
    return (F.floor((F.dayofmonth(day) + F.weekday(F.trunc(day, "month")) - 1) / 7) + 1).cast("long")


def third_friday(day: Column | str) -> Column:
    day = _col(day)
    return (F.weekday(day) == 4) & F.dayofmonth(day).between(15, 21)


def expiry_week(day: Column | str) -> Column:
    """Whether the day's week, Monday to Sunday, holds its month's third Friday."""
    return third_friday(F.date_add(F.trunc(_col(day), "week"), 4))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th given weekday (0 is Monday) of a month."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: int) -> Column:
    end = F.last_day(F.make_date(year.cast("int"), F.lit(month), F.lit(1)))
    return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)))


def observed(day: Column) -> Column:
    """A holiday's day off: Friday for a Saturday, Monday for a Sunday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def easter(year: Column) -> Column:
    """Easter Sunday in the Gregorian calendar, by the anonymous algorithm."""
    div = lambda x, n: F.floor(x / n)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    k = h + l - 7 * div(a + 11 * h + 22 * l, 451) + 114
    return F.make_date(year.cast("int"), div(k, 31).cast("int"), (k % 31 + 1).cast("int"))


def us_holidays(year: Column) -> Column:
    """Exchange holidays of a year as an array of days."""
    fixed = lambda m, d: observed(F.make_date(year.cast("int"), F.lit(m), F.lit(d)))
    days = [
        fixed(1, 1),
        nth_weekday(year, 1, 0, 3),
        nth_weekday(year, 2, 0, 3),
        F.date_sub(easter(year), 2),
        last_weekday(year, 5, 0),
        F.when(year >= 2022, fixed(6, 19)),
        fixed(7, 4),
        nth_weekday(year, 9, 0, 1),
        nth_weekday(year, 11, 3, 4),
        fixed(12, 25),
    ]
    return F.array_sort(F.array_compact(F.array(*days)))


def session_state(ts: Column | str, opens: int = 570, closes: int = 960) -> Column:
    """Market state at a local time: pre, open or closed; times in minutes of the day."""
    ts = _col(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(F.weekday(ts) > 4, "closed").when(minute < opens, "pre").when(minute < closes, "open").otherwise("closed")
