"""Measures that are reported alongside the queries and built on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import average_days, quarter_of, within
from ..functions.money import from_cents
from ..functions.rates import growth_percent, percent, rounded
from ..operators.delivered import (
    delivered_facts,
    handling_durations,
    has_status_delivered,
    is_delivered,
    order_values,
)
from ..settings import Settings
from .chart_data import monthly_buffer_vs_late
from .kpis import category_analysis

Tables = Mapping[str, DataFrame]


def late_rate_by_definition(t: Tables, s: Settings) -> DataFrame:
    """Late rate by calendar date and by exact time; state which one is quoted."""
    by_time = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    return delivered_facts(t["orders"]).agg(
        rounded(percent(F.count_if("is_late"), F.count("is_late"))).alias("late_rate_by_date_pct"),
        rounded(percent(F.count_if(by_time), F.count(by_time))).alias("late_rate_by_time_pct"),
    )


def repeat_purchase_rate(t: Tables, s: Settings) -> DataFrame:
    """Share of buying persons with two or more orders.

    The definition is inferred: the published figure comes without one. Orders
    are counted per order-level id first, so a busy id is one row in the join.
    """
    per_id = t["orders"].groupBy("customer_id").agg(F.count("*").alias("orders"))
    return (
        per_id.join(t["customers"].select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("orders").alias("orders"))
        .agg(
            F.count("*").alias("customers"),
            F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
        )
        .withColumn(
            "repeat_purchase_pct", rounded(percent("repeat_customers", "customers"))
        )
    )


def carrier_share(t: Tables, s: Settings) -> DataFrame:
    """Part of the handling time spent with the carrier, over possible durations."""
    return (
        handling_durations(delivered_facts(t["orders"]))
        .where("possible")
        .agg(
            F.count("*").alias("orders"),
            average_days("seller_micros").alias("seller"),
            average_days("carrier_micros").alias("carrier"),
        )
        .select(
            "orders",
            rounded("seller").alias("avg_seller_days"),
            rounded("carrier").alias("avg_carrier_days"),
            rounded(percent("carrier", F.col("seller") + F.col("carrier"))).alias(
                "carrier_share_pct"
            ),
        )
    )


def buffer_threshold(t: Tables, s: Settings) -> DataFrame:
    """Each month's buffer against the warning threshold, with its late rate."""
    return (
        monthly_buffer_vs_late(t, s)
        .select(
            "month",
            rounded("avg_buffer_days").alias("avg_buffer_days"),
            rounded("late_rate_pct").alias("late_rate_pct"),
            (F.col("avg_buffer_days") < s.buffer_days).alias("below_threshold"),
            (F.col("late_rate_pct") >= s.high_late_rate_pct).alias("double_digit_late_rate"),
        )
        .orderBy("month")
    )


def category_weight_correlation(t: Tables, s: Settings) -> DataFrame:
    """Pearson correlation of mean weight and late rate over categories."""
    return category_analysis(t, s).agg(
        F.count("*").alias("categories"),
        rounded(F.corr("avg_weight_g", "late_rate_pct"), 6).alias("r"),
    )


def period_growth(t: Tables, s: Settings) -> DataFrame:
    """Quarter-over-quarter growth of delivered value by purchase and by delivery date.

    One pass: each order is valued once and counts in the quarter it was bought
    in, and in the quarter it arrived in if it has items.
    """
    bought, arrived = "order_purchase_timestamp", "order_delivered_customer_date"
    window = s.quarters
    in_bought = within(bought, window.start, window.end)
    in_arrived = is_delivered() & within(arrived, window.start, window.end)
    delivered_cents = F.when(F.col("delivered"), F.col("cents"))
    bases = F.array(
        F.struct(F.lit("purchase").alias("basis"), F.col("bought").alias("quarter"), delivered_cents.alias("cents")),
        F.struct(
            F.lit("delivery").alias("basis"),
            F.when(F.col("cents").isNotNull(), F.col("arrived")).alias("quarter"),
            F.col("cents").alias("cents"),
        ),
    )
    gmv = F.col("delivered_gmv")
    before = F.lag(gmv).over(Window.partitionBy("basis").orderBy("quarter"))
    return (
        t["orders"]
        .where(in_bought | in_arrived)
        .select(
            "order_id",
            has_status_delivered().alias("delivered"),
            F.when(in_bought, quarter_of(bought)).alias("bought"),
            F.when(in_arrived, quarter_of(arrived)).alias("arrived"),
        )
        .join(order_values(t["order_items"]), "order_id", "left")
        .select(F.inline(bases))
        .where("quarter IS NOT NULL")
        .groupBy("basis", "quarter")
        .agg(from_cents(F.sum("cents")).alias("delivered_gmv"))
        .withColumn("gmv_growth_pct", rounded(growth_percent(gmv, before)))
        .orderBy("basis", "quarter")
    )
