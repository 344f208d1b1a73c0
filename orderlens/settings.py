"""Parameters of the query catalogue: date ranges, thresholds, constants."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class DateRange:
    """Half-open range of dates ``[start, end)``."""

    start: date
    end: date


@dataclass(frozen=True)
class Period:
    """A named half-open range, with the short name used in two-way breakdowns."""

    name: str
    short_name: str
    dates: DateRange


@dataclass(frozen=True)
class Settings:
    # The defaults every published result was computed with.
    analysis: DateRange = DateRange(date(2017, 1, 1), date(2018, 9, 1))
    review_coverage: DateRange = DateRange(date(2017, 1, 1), date(2018, 7, 1))
    quarters: DateRange = DateRange(date(2017, 10, 1), date(2018, 4, 1))
    base_period: Period = Period(
        "Jan-Jun 2017", "2017", DateRange(date(2017, 1, 1), date(2017, 7, 1))
    )
    next_period: Period = Period(
        "Jan-Jun 2018", "2018", DateRange(date(2018, 1, 1), date(2018, 7, 1))
    )
    min_state_orders: int = 100
    min_late_reviews: int = 30
    min_seller_orders: int = 20
    min_category_orders: int = 30
    low_score: int = 2
    buffer_days: float = 8.0
    high_late_rate_pct: float = 10.0
    moving_months: int = 3
    confidence_z: float = 1.96
    # A delivery date is suspicious when this many late orders share it, bought
    # over at least this many days, the worst at least this many days late.
    batch_min_orders: int = 8
    batch_min_purchase_spread: int = 14
    batch_min_days_late: int = 150


@dataclass(frozen=True)
class RowFloor:
    """Smallest row count expected of a source table."""

    table: str
    rows: int


# Expected minimum sizes of the raw extract.
ROW_FLOORS = (RowFloor("orders", 90_000), RowFloor("customers", 90_000))
