"""The two multi-step business cases: order value by quarter, low scores by period."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_of, quarter_of, within
from ..functions.money import from_cents
from ..functions.rates import percent, ratio, rounded, total_when
from ..operators.delivered import (
    delivered_facts,
    has_status_delivered,
    order_values,
    with_review_score,
)
from ..settings import Settings

Tables = Mapping[str, DataFrame]

BOUGHT = "order_purchase_timestamp"


def gmv_by_purchase_quarter(t: Tables, s: Settings) -> DataFrame:
    """Orders and value per purchase quarter, for all and for delivered orders.

    Orders without items stay: they count, with no value, also in the
    denominator of the average.
    """
    delivered = has_status_delivered()
    delivered_gmv = from_cents(total_when(delivered, "cents"))
    return (
        t["orders"]
        .where(within(BOUGHT, s.quarters.start, s.quarters.end))
        .select("order_id", "order_status", quarter_of(BOUGHT).alias("quarter"))
        .join(order_values(t["order_items"]), "order_id", "left")
        .groupBy("quarter")
        .agg(
            F.count("*").alias("all_orders"),
            from_cents(F.sum("cents")).alias("all_orders_gmv"),
            F.count_if(delivered).alias("delivered_orders"),
            delivered_gmv.alias("delivered_gmv"),
            rounded(ratio(delivered_gmv, F.count_if(delivered))).alias("aov"),
        )
        .orderBy("quarter")
    )


def gmv_by_delivery_quarter(t: Tables, s: Settings) -> DataFrame:
    """Delivered orders with items and their value per delivery quarter."""
    arrived = "order_delivered_customer_date"
    return (
        delivered_facts(t["orders"])
        .where(within(arrived, s.quarters.start, s.quarters.end))
        .select("order_id", quarter_of(arrived).alias("quarter"))
        .join(order_values(t["order_items"]), "order_id")
        .groupBy("quarter")
        .agg(
            F.count("*").alias("delivered_orders"),
            from_cents(F.sum("cents")).alias("delivered_gmv"),
        )
        .withColumn("aov", rounded(ratio("delivered_gmv", "delivered_orders")))
        .orderBy("quarter")
    )


def review_coverage(t: Tables, s: Settings) -> DataFrame:
    """Share of delivered orders with a review, per purchase month."""
    window = s.review_coverage
    delivered = delivered_facts(t["orders"]).where(within(BOUGHT, window.start, window.end))
    return (
        with_review_score(delivered, t["order_reviews"])
        .groupBy(month_of(BOUGHT).alias("month"))
        .agg(
            F.count("*").alias("delivered_orders"),
            F.count("review_score").alias("reviewed_orders"),
            rounded(percent(F.count("review_score"), F.count("*"))).alias("review_coverage_pct"),
        )
        .orderBy("month")
    )


def _period(s: Settings, name: str) -> tuple[Column, Column]:
    """Condition selecting the two compared periods, and the label of each row's period."""
    base, following = s.base_period, s.next_period
    in_base = within(BOUGHT, base.dates.start, base.dates.end)
    in_next = within(BOUGHT, following.dates.start, following.dates.end)
    label = F.when(in_base, getattr(base, name)).when(in_next, getattr(following, name))
    return in_base | in_next, label.alias("period")


def _compared_orders(t: Tables, s: Settings, name: str = "name") -> DataFrame:
    compared, label = _period(s, name)
    return (
        delivered_facts(t["orders"])
        .where(compared)
        .select(
            "order_id",
            label,
            "is_late",
            F.when(F.col("is_late"), "late").otherwise("on_time").alias("delivery_status"),
        )
    )


def low_score_counts(t: Tables, s: Settings) -> DataFrame:
    """Orders, reviewed and low-score orders per period."""
    score = F.col("review_score")
    return (
        with_review_score(_compared_orders(t, s), t["order_reviews"])
        .groupBy("period")
        .agg(
            F.count("*").alias("delivered_orders"),
            F.count(score).alias("reviewed_orders"),
            F.count_if(score <= s.low_score).alias("low_score_orders"),
        )
    )


def low_score_by_period(t: Tables, s: Settings) -> DataFrame:
    """Share of low scores among reviewed orders in the two compared periods."""
    return (
        low_score_counts(t, s)
        .withColumn(
            "low_score_rate_pct", rounded(percent("low_score_orders", "reviewed_orders"))
        )
        .orderBy("period")
    )


def late_by_period(t: Tables, s: Settings) -> DataFrame:
    """Late share of delivered orders in the two compared periods."""
    return (
        _compared_orders(t, s)
        .groupBy("period")
        .agg(
            F.count("*").alias("delivered_orders"),
            F.count_if("is_late").alias("late_orders"),
            rounded(percent(F.count_if("is_late"), F.count("*"))).alias("late_rate_pct"),
        )
        .orderBy("period")
    )


def period_status_counts(t: Tables, s: Settings) -> DataFrame:
    """Orders, reviewed and low-score orders per period and delivery status."""
    score = F.col("review_score")
    return (
        with_review_score(_compared_orders(t, s, "short_name"), t["order_reviews"])
        .groupBy("period", "delivery_status")
        .agg(
            F.count("*").alias("orders"),
            F.count(score).alias("reviewed_orders"),
            F.count_if(score <= s.low_score).alias("low_score_orders"),
        )
    )


def low_score_period_x_status(t: Tables, s: Settings) -> DataFrame:
    """Low-score share per period and delivery status."""
    return (
        period_status_counts(t, s)
        .select(
            "period",
            "delivery_status",
            "orders",
            "reviewed_orders",
            rounded(percent("low_score_orders", "reviewed_orders")).alias("low_score_rate_pct"),
        )
        .orderBy("period", "delivery_status")
    )
