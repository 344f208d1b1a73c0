"""Rounding, ratios and percentages shared by every query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import column


def rounded(value: Column | str, places: int = 2) -> Column:
    """Round half away from zero.

    The value passes through ``decimal(38,8)`` first, so 1.005 held as a double
    rounds to 1.01 rather than depending on its last bit. 30 integer digits are
    left, enough for money totals of any size.
    """
    return F.round(column(value).cast("decimal(38,8)"), places).cast("double")


def significant(value: Column | str) -> Column:
    """Six significant digits, however small the value is; through text, so zero means zero."""
    return F.format_string("%.5e", column(value).cast("double")).try_cast("double")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is zero."""
    return column(part).cast("double") / F.nullif(column(whole).cast("double"), F.lit(0.0))


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole`` unrounded, NULL when ``whole`` is zero."""
    return F.lit(100.0) * ratio(part, whole)


def growth_percent(current: Column, previous: Column) -> Column:
    """Relative change in percent; NULL without a previous value or when it is zero."""
    return F.lit(100.0) * (current - previous).cast("double") / F.nullif(
        previous.cast("double"), F.lit(0.0)
    )


def total_when(condition: Column, value: Column | str) -> Column:
    """``SUM(value)`` over the rows that satisfy ``condition``."""
    return F.sum(F.when(condition, column(value)))


def count_when(condition: Column, value: Column | str) -> Column:
    """``COUNT(value)`` (non-null) over the rows that satisfy ``condition``."""
    return F.count(F.when(condition, column(value)))
