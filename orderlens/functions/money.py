"""Exact money totals over whole cents.

A decimal sum widens by ten digits and leaves Spark's 64-bit decimals, which
more than doubles the cost of an aggregation and the size of its shuffled rows.
Amounts have two digits, so their cents add up just as exactly in a BIGINT,
with room for 9e16 units of currency; beyond it ANSI mode raises an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calendar import column


def in_cents(amount: Column | str) -> Column:
    """Whole cents of a two-digit decimal amount."""
    return (column(amount) * 100).cast("bigint")


def from_cents(cents: Column | str) -> Column:
    """The two-digit decimal amount of whole cents."""
    return (column(cents).cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast("decimal(21,2)")


def require_cents(df: DataFrame, *amounts: str) -> None:
    """Raise unless the columns are decimals of at most two digits."""
    for name in amounts:
        kind = df.schema[name].dataType
        if not isinstance(kind, T.DecimalType) or kind.scale > 2:
            raise TypeError(f"{name} must be a decimal with at most two digits, not {kind}")
