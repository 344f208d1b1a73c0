"""Datasets behind the charts, unrounded. Drawing them is left to the caller."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_days_between, month_of, within
from ..functions.rates import percent, ratio
from ..operators.delivered import delivered_facts, with_review_score
from ..settings import Settings

Tables = Mapping[str, DataFrame]

BOUGHT = "order_purchase_timestamp"


def monthly_late_rate(t: Tables, s: Settings) -> DataFrame:
    """Late rate per purchase month."""
    return (
        delivered_facts(t["orders"])
        .where(within(BOUGHT, s.analysis.start, s.analysis.end))
        .groupBy(month_of(BOUGHT).alias("month"))
        .agg(percent(F.count_if("is_late"), F.count("is_late")).alias("late_rate_pct"))
        .orderBy("month")
    )


def review_score_distribution(t: Tables, s: Settings) -> DataFrame:
    """Share of each score among late and among on-time reviewed orders."""
    within_group = Window.partitionBy("group")
    return (
        with_review_score(delivered_facts(t["orders"]), t["order_reviews"], "inner")
        .select(
            F.when(F.col("is_late"), "Late").when(~F.col("is_late"), "On-time").alias("group"),
            "review_score",
        )
        .dropna()
        .groupBy("group", "review_score")
        .agg(F.count("*").alias("n"))
        .select(
            "group", "review_score", percent("n", F.sum("n").over(within_group)).alias("percentage")
        )
        .orderBy("group", "review_score")
    )


def monthly_buffer_vs_late(t: Tables, s: Settings) -> DataFrame:
    """Mean promise buffer (days delivered ahead of the promise) and late rate per month."""
    buffer = calendar_days_between("order_delivered_customer_date", "order_estimated_delivery_date")
    return (
        delivered_facts(t["orders"])
        .where(within(BOUGHT, s.analysis.start, s.analysis.end))
        .groupBy(month_of(BOUGHT).alias("month"))
        .agg(
            ratio(F.sum(buffer), F.count(buffer)).alias("avg_buffer_days"),
            percent(F.count_if("is_late"), F.count("is_late")).alias("late_rate_pct"),
        )
        .orderBy("month")
    )
