"""Date and duration expressions on zone-less timestamps.

Nothing here reads the session time zone. ``timestampdiff`` is avoided on
purpose: it casts a zone-less timestamp to a zoned one first, so a daylight
saving change in the session zone shifts the result by an hour.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SECONDS_PER_DAY = 86_400.0
MICROS_PER_DAY = 86_400_000_000.0


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Exact microseconds from ``start`` to ``end``; NULL if either is NULL."""
    seconds = (column(end) - column(start)).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def as_days(micros: Column | str) -> Column:
    """Fractional days of a number of microseconds. Totals are `total_days`, not sums of these."""
    return column(micros).cast("double") / F.lit(MICROS_PER_DAY)


def split_sum(micros: Column | str) -> tuple[Column, Column]:
    """Sums of the whole seconds and of the microseconds beyond them, two exact BIGINTs.

    A single BIGINT sum would overflow after some ten million ten-day durations;
    these two have room for 9e12 of them and do not depend on the rows' order.
    """
    beyond = F.pmod(column(micros), F.lit(MICROS_PER_SECOND))
    seconds = ((column(micros) - beyond) / MICROS_PER_SECOND).cast("bigint")
    return F.sum(seconds), F.sum(beyond)


def mean_days(seconds: Column | str, beyond: Column | str, n: Column | str) -> Column:
    """Mean fractional days from the two sums of `split_sum`; NULL without rows."""
    total = column(seconds).cast("double") + column(beyond).cast("double") / MICROS_PER_SECOND
    return total / SECONDS_PER_DAY / F.nullif(column(n).cast("double"), F.lit(0.0))


def average_days(micros: Column | str) -> Column:
    """Mean fractional days of the non-null durations, as an aggregate."""
    return mean_days(*split_sum(micros), F.count(column(micros)))


def calendar_days_between(start: Column | str, end: Column | str) -> Column:
    """Whole calendar days from the date of ``start`` to the date of ``end``."""
    return F.datediff(F.to_date(column(end)), F.to_date(column(start)))


def month_of(ts: Column | str) -> Column:
    """First day of the month as a DATE."""
    return F.trunc(F.to_date(column(ts)), "month")


def quarter_of(ts: Column | str) -> Column:
    """First day of the quarter as a DATE."""
    return F.trunc(F.to_date(column(ts)), "quarter")


def within(ts: Column | str, start: date, end: date) -> Column:
    """Half-open range ``[start, end)`` with typed DATE bounds, so it reaches the file scan."""
    c = column(ts)
    return (c >= F.lit(start)) & (c < F.lit(end))


def later_date(actual: Column | str, promised: Column | str) -> Column:
    """True when ``actual`` falls on a later calendar date than ``promised``.

    The promise is stored at midnight, so comparing timestamps would call a
    delivery on the promised day late. NULL if either side is NULL.
    """
    return F.to_date(column(actual)) > F.to_date(column(promised))
