"""The ten business-question queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import (
    as_days,
    average_days,
    calendar_days_between,
    mean_days,
    month_of,
    split_sum,
    within,
)
from ..functions.medians import middle_values
from ..functions.money import from_cents
from ..functions.rates import (
    count_when,
    growth_percent,
    percent,
    ratio,
    rounded,
    total_when,
)
from ..operators.delivered import (
    delivered_facts,
    handling_durations,
    has_status_delivered,
    is_delivered,
    is_late,
    item_values,
    order_values,
    with_review_score,
)
from ..operators.joins import lookup
from ..settings import Settings
from ..sources.tables import ENGLISH_CATEGORY

Tables = Mapping[str, DataFrame]

# Bucket widths, in microseconds, that locate a median duration: a minute, a hundredth
# of a second, exact. A year of durations is half a million minutes; a minute holds 6,000
# of the second buckets and each of these at most 10,000 values.
_DURATION_WIDTHS = (60_000_000, 10_000, 1)


def _delivered_in_window(t: Tables, s: Settings) -> DataFrame:
    bought = "order_purchase_timestamp"
    return delivered_facts(t["orders"]).where(within(bought, s.analysis.start, s.analysis.end))


def baseline_kpis(t: Tables, s: Settings) -> DataFrame:
    """Orders with status delivered that have items: count, value, average value."""
    delivered = t["orders"].where(has_status_delivered()).select("order_id")
    return (
        order_values(t["order_items"])
        .join(delivered, "order_id")
        .agg(
            F.count("*").alias("total_orders"),
            from_cents(F.sum("cents")).alias("total_revenue"),
        )
        .withColumn("aov", rounded(ratio("total_revenue", "total_orders")))
    )


def late_delivery_rate(t: Tables, s: Settings) -> DataFrame:
    """Delivered orders, late share, mean and exact median delivery time.

    The pass that counts durations per minute for the median also sums the rest.
    """
    seconds, beyond = split_sum("delivery_micros")
    middle = middle_values(
        delivered_facts(t["orders"]),
        "delivery_micros",
        widths=_DURATION_WIDTHS,
        totals={
            "orders": F.count("*"),
            "timed": F.count("delivery_micros"),
            "late": F.count_if("is_late"),
            "dated": F.count("is_late"),
            "seconds": seconds,
            "beyond": beyond,
        },
    )
    median_days = (as_days("lower") + as_days("upper")) / 2.0
    return middle.select(
        F.coalesce("orders", F.lit(0)).alias("delivered_orders"),
        F.coalesce("late", F.lit(0)).alias("late_orders"),
        rounded(percent("late", "dated")).alias("late_rate_pct"),
        rounded(mean_days("seconds", "beyond", "timed")).alias("avg_delivery_days"),
        rounded(median_days).alias("median_delivery_days"),
    )


def state_totals(t: Tables) -> DataFrame:
    """Sums per customer state that state rates and score comparisons are made of.

    Orders are summed per customer before customers are joined, so a customer
    with very many orders is one row on each side of that join.
    """
    orders = with_review_score(delivered_facts(t["orders"]), t["order_reviews"])
    late, score = F.col("is_late"), F.col("review_score")
    per_customer = orders.groupBy("customer_id").agg(
        F.count("*").alias("orders"),
        F.count_if(late).alias("late_orders"),
        F.count(late).alias("dated_orders"),
        F.count("delivery_micros").alias("timed_orders"),
        split_sum("delivery_micros")[0].alias("delivery_seconds"),
        split_sum("delivery_micros")[1].alias("delivery_micros"),
        F.count(score).alias("reviewed"),
        F.sum(score).alias("score"),
        count_when(late, score).alias("late_reviewed"),
        total_when(late, score).alias("late_score"),
        count_when(~late, score).alias("on_time_reviewed"),
        total_when(~late, score).alias("on_time_score"),
    )
    sums = [c for c in per_customer.columns if c != "customer_id"]
    return (
        per_customer.join(t["customers"].select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def state_performance(t: Tables, s: Settings) -> DataFrame:
    """Late rate, delivery time and review score per state with enough orders."""
    return (
        state_totals(t)
        .where(F.col("orders") >= s.min_state_orders)
        .select(
            "customer_state",
            F.col("orders").alias("delivered_orders"),
            rounded(percent("late_orders", "dated_orders")).alias("late_rate_pct"),
            rounded(mean_days("delivery_seconds", "delivery_micros", "timed_orders")).alias(
                "avg_delivery_days"
            ),
            rounded(ratio("score", "reviewed")).alias("avg_review_score"),
        )
        .orderBy(F.col("late_rate_pct").desc_nulls_first(), "customer_state")
    )


def delay_vs_review(t: Tables, s: Settings) -> DataFrame:
    """Review scores of on-time and late orders; low share over reviewed orders.

    Grouped by the flag, not its label: orders of unknown lateness form their
    own row, labelled on_time.
    """
    score = F.col("review_score")
    return (
        with_review_score(delivered_facts(t["orders"]), t["order_reviews"])
        .groupBy("is_late")
        .agg(
            F.count("*").alias("delivered_orders"),
            F.count(score).alias("reviewed_orders"),
            rounded(ratio(F.sum(score), F.count(score))).alias("avg_review_score"),
            rounded(percent(F.count_if(score <= s.low_score), F.count(score))).alias(
                "low_score_pct"
            ),
        )
        .orderBy(F.col("is_late").asc_nulls_last())
        .select(
            F.when(F.col("is_late"), "late").otherwise("on_time").alias("delivery_status"),
            "delivered_orders",
            "reviewed_orders",
            "avg_review_score",
            "low_score_pct",
        )
    )


def state_confounding(t: Tables, s: Settings) -> DataFrame:
    """Score gap between on-time and late orders within each state with enough late reviews."""
    on_time = ratio("on_time_score", "on_time_reviewed")
    late = ratio("late_score", "late_reviewed")
    return (
        state_totals(t)
        .where(F.col("late_reviewed") >= s.min_late_reviews)
        .select(
            "customer_state",
            "late_orders",
            rounded(on_time).alias("on_time_avg_score"),
            rounded(late).alias("late_avg_score"),
            rounded(on_time - late).alias("score_gap"),
        )
        .orderBy(F.col("score_gap").desc_nulls_first(), "customer_state")
    )


def monthly_trend(t: Tables, s: Settings) -> DataFrame:
    """Orders, value, value growth and late rate per purchase month."""
    by_month = Window.partitionBy(F.lit(0)).orderBy("month")
    gmv = F.col("gmv")
    return (
        _delivered_in_window(t, s)
        .select("order_id", month_of("order_purchase_timestamp").alias("month"), "is_late")
        .join(order_values(t["order_items"]), "order_id")
        .groupBy("month")
        .agg(
            F.count("*").alias("delivered_orders"),
            from_cents(F.sum("cents")).alias("gmv"),
            percent(F.count_if("is_late"), F.count("is_late")).alias("late_rate"),
        )
        .select(
            "month",
            "delivered_orders",
            "gmv",
            rounded(growth_percent(gmv, F.lag(gmv).over(by_month))).alias("gmv_mom_growth_pct"),
            rounded("late_rate").alias("late_rate_pct"),
        )
        .orderBy("month")
    )


def seller_vs_carrier(t: Tables, s: Settings) -> DataFrame:
    """Mean days with seller and carrier per month, late rate and its moving average.

    Impossible durations are left out of the two means only. The moving
    average weighs months equally and starts once enough months exist.
    """
    possible = F.col("possible")
    by_month = Window.partitionBy(F.lit(0)).orderBy("month")
    recent = by_month.rowsBetween(1 - s.moving_months, 0)
    return (
        handling_durations(_delivered_in_window(t, s))
        .groupBy(month_of("order_purchase_timestamp").alias("month"))
        .agg(
            rounded(average_days(F.when(possible, F.col("seller_micros")))).alias(
                "avg_seller_days"
            ),
            rounded(average_days(F.when(possible, F.col("carrier_micros")))).alias(
                "avg_carrier_days"
            ),
            percent(F.count_if("is_late"), F.count("is_late")).alias("late_rate"),
        )
        .select(
            "month",
            "avg_seller_days",
            "avg_carrier_days",
            rounded("late_rate").alias("late_rate_pct"),
            F.when(
                F.row_number().over(by_month) >= s.moving_months,
                rounded(F.avg("late_rate").over(recent)),
            ).alias("late_rate_3m_avg"),
        )
        .orderBy("month")
    )


def promised_vs_actual(t: Tables, s: Settings) -> DataFrame:
    """Promised, actual and buffer days per month, and the delivered share of all orders.

    One scan of all orders of the window: the delivered measures are
    conditional, so the all-order denominator needs no second scan or join.
    """
    bought = "order_purchase_timestamp"
    promised, arrived = "order_estimated_delivery_date", "order_delivered_customer_date"

    def mean_days(start: str, end: str):
        days = F.when(is_delivered(), calendar_days_between(start, end))
        return rounded(ratio(F.sum(days), F.count(days)))

    late = F.when(is_delivered(), is_late())
    delivered = F.count_if(is_delivered())
    return (
        t["orders"]
        .where(within(bought, s.analysis.start, s.analysis.end))
        .groupBy(month_of(bought).alias("month"))
        .agg(
            mean_days(bought, promised).alias("avg_promised_days"),
            mean_days(bought, arrived).alias("avg_actual_days"),
            mean_days(arrived, promised).alias("avg_buffer_days"),
            rounded(percent(F.count_if(late), F.count(late))).alias("late_rate_pct"),
            rounded(percent(delivered, F.count("*"))).alias("delivered_share_pct"),
            delivered.alias("delivered_orders"),
        )
        .where("delivered_orders > 0")
        .drop("delivered_orders")
        .orderBy("month")
    )


def seller_late_rate(t: Tables, s: Settings) -> DataFrame:
    """Late rate and value per seller with enough orders.

    An order counts once for each of its sellers.
    """
    late = delivered_facts(t["orders"]).select("order_id", "is_late")
    return (
        item_values(t["order_items"], "order_id", "seller_id")
        .join(late, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("orders"),
            rounded(percent(F.count_if("is_late"), F.count("*"))).alias("late_rate_pct"),
            from_cents(F.sum("cents")).alias("total_gmv"),
        )
        .where(F.col("orders") >= s.min_seller_orders)
        .join(t["sellers"].select("seller_id", "seller_state"), "seller_id")
        .select("seller_id", "seller_state", "orders", "late_rate_pct", "total_gmv")
        .orderBy(F.col("late_rate_pct").desc(), F.col("orders").desc(), "seller_id")
    )


def category_analysis(t: Tables, s: Settings) -> DataFrame:
    """Late rate, mean catalogue weight and value per category with enough orders.

    Items meet their category first and are summed per (order, category) ahead
    of the join by order. The mean weight is over the catalogue, not over sales.
    """
    category = F.col(ENGLISH_CATEGORY).alias("category")
    late = delivered_facts(t["orders"]).select("order_id", "is_late")
    weight = F.col("product_weight_g")
    weights = (
        t["products"]
        .groupBy(category)
        .agg(rounded(ratio(F.sum(weight), F.count(weight))).alias("avg_weight_g"))
    )
    items = t["order_items"].select("order_id", "product_id", "price", "freight_value")
    named_items = lookup(items, t["products"].select("product_id", category), "product_id")
    return (
        item_values(named_items, "order_id", "category")
        .join(late, "order_id")
        .groupBy("category")
        .agg(
            F.count("*").alias("orders"),
            rounded(percent(F.count_if("is_late"), F.count("*"))).alias("late_rate_pct"),
            from_cents(F.sum("cents")).alias("total_gmv"),
        )
        .where(F.col("orders") >= s.min_category_orders)
        .join(weights, "category")
        .select("category", "orders", "late_rate_pct", "avg_weight_g", "total_gmv")
        .orderBy(F.col("late_rate_pct").desc(), "category")
    )
