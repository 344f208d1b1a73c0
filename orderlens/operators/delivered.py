"""The delivered-order base every delivery measure starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import as_days, later_date, micros_between
from ..functions.money import in_cents, require_cents

DELIVERED_COLUMNS = (
    "order_id",
    "customer_id",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "is_late",
    "delivery_days",
)


def has_status_delivered() -> Column:
    """Status alone; such an order may still lack its delivery date."""
    return F.col("order_status") == "delivered"


def is_delivered() -> Column:
    """Delivered and dated: the population of every delivery-time measure."""
    return has_status_delivered() & F.col("order_delivered_customer_date").isNotNull()


def is_late() -> Column:
    return later_date("order_delivered_customer_date", "order_estimated_delivery_date")


def delivered_facts(orders: DataFrame) -> DataFrame:
    """Delivered orders with lateness and exact durations.

    Carries the carrier date as well, so no query joins the orders table to
    itself to fetch it.
    """
    return orders.where(is_delivered()).select(
        "order_id",
        "customer_id",
        "order_purchase_timestamp",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        is_late().alias("is_late"),
        micros_between("order_purchase_timestamp", "order_delivered_customer_date").alias(
            "delivery_micros"
        ),
    ).withColumn("delivery_days", as_days("delivery_micros"))


def delivered_orders(orders: DataFrame) -> DataFrame:
    """The shared view: one row per delivered, dated order."""
    return delivered_facts(orders).select(*DELIVERED_COLUMNS)


def item_values(items: DataFrame, *grain: str | Column) -> DataFrame:
    """Value of the items, in cents, per order or per finer ``grain`` that includes the order.

    Summing before any join by order keeps that join from fanning out, and
    sends a huge order, seller or product as one row per task.
    """
    require_cents(items, "price", "freight_value")
    return items.groupBy(*grain).agg(
        F.sum(in_cents(F.col("price") + F.col("freight_value"))).alias("cents")
    )


def order_values(items: DataFrame) -> DataFrame:
    """Value of each order's items, in cents."""
    return item_values(items, "order_id")


def with_review_score(orders: DataFrame, reviews: DataFrame, how: str = "left") -> DataFrame:
    """Add the score of the order's one review; ``left`` keeps unreviewed orders."""
    return orders.join(reviews.select("order_id", "review_score"), "order_id", how)


def handling_durations(delivered: DataFrame) -> DataFrame:
    """Microseconds spent with the seller and with the carrier, and whether both are possible.

    ``possible`` is NULL without a carrier date and false when the carrier date
    lies before the purchase or after the delivery.
    """
    bought, handed = "order_purchase_timestamp", "order_delivered_carrier_date"
    return delivered.select(
        bought,
        "is_late",
        micros_between(bought, handed).alias("seller_micros"),
        micros_between(handed, "order_delivered_customer_date").alias("carrier_micros"),
    ).withColumn("possible", (F.col("seller_micros") >= 0) & (F.col("carrier_micros") >= 0))
