"""Statistics over query results. All inputs are already aggregated to a few rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import (
    correlation_p,
    normal_two_sided_p,
    pearson_t,
    two_proportion_z,
    wald_interval,
)
from ..functions.rates import ratio, rounded, significant
from ..settings import Settings
from .business_cases import low_score_counts, period_status_counts
from .chart_data import monthly_buffer_vs_late
from .kpis import state_performance

Tables = Mapping[str, DataFrame]


def buffer_late_correlation(t: Tables, s: Settings) -> DataFrame:
    """Pearson correlation of monthly buffer and late rate."""
    return monthly_buffer_vs_late(t, s).agg(
        F.count("*").alias("months"),
        rounded(F.corr("avg_buffer_days", "late_rate_pct"), 6).alias("r"),
    )


def correlation_test(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of two columns with its two-sided p-value, unrounded."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return (
        pairs.agg(F.count_if(both).alias("n"), F.corr(x, y).alias("r"))
        .withColumn("t", pearson_t(F.col("r"), F.col("n")))
        .withColumn("p_value", correlation_p(F.col("r"), F.col("n")))
    )


def buffer_late_significance(t: Tables, s: Settings) -> DataFrame:
    """Correlation of monthly buffer and late rate with its p-value."""
    return correlation_test(
        monthly_buffer_vs_late(t, s), "avg_buffer_days", "late_rate_pct"
    ).select(
        F.col("n").alias("months"),
        rounded("r", 6).alias("r"),
        significant("p_value").alias("p_value"),
    )


def buffer_late_line(t: Tables, s: Settings) -> DataFrame:
    """Least-squares line of the monthly late rate on the buffer."""
    x, y = F.col("avg_buffer_days"), F.col("late_rate_pct")
    return monthly_buffer_vs_late(t, s).agg(
        rounded(F.regr_slope(y, x), 6).alias("slope"),
        rounded(F.regr_intercept(y, x), 6).alias("intercept"),
    )


def state_late_rate_interval(t: Tables, s: Settings) -> DataFrame:
    """Confidence interval of every state's late rate."""
    low, high = wald_interval("late_rate_pct", "delivered_orders", s.confidence_z)
    return state_performance(t, s).select(
        "customer_state",
        "delivered_orders",
        "late_rate_pct",
        rounded(low).alias("ci_low_pct"),
        rounded(high).alias("ci_high_pct"),
    )


def low_score_change(t: Tables, s: Settings) -> DataFrame:
    """Two-proportion z-test of the low-score rate between the two periods, unrounded."""

    def of(period: str, column: str):
        return F.max(F.when(F.col("period") == period, F.col(column)))

    base, following = s.base_period.name, s.next_period.name
    return (
        low_score_counts(t, s)
        .agg(
            of(base, "low_score_orders").alias("hits0"),
            of(base, "reviewed_orders").alias("n0"),
            of(following, "low_score_orders").alias("hits1"),
            of(following, "reviewed_orders").alias("n1"),
        )
        .withColumn(
            "z", two_proportion_z(F.col("hits0"), F.col("n0"), F.col("hits1"), F.col("n1"))
        )
        .withColumn("p_value", normal_two_sided_p(F.col("z")))
    )


def low_score_z_test(t: Tables, s: Settings) -> DataFrame:
    """Significance of the change in the low-score rate."""
    return low_score_change(t, s).select(
        rounded(100.0 * ratio("hits0", "n0")).alias("base_rate_pct"),
        rounded(100.0 * ratio("hits1", "n1")).alias("next_rate_pct"),
        rounded("z", 6).alias("z"),
        significant("p_value").alias("p_value"),
    )


def decompose_change(counts: DataFrame, base: str, following: str) -> DataFrame:
    """Split the change of the low-score rate into mix shift and within-group change.

    The mix shift is the growth of the late share times the base-period gap
    between late and on-time rates, shares being over reviewed orders; the rest
    of the change is within groups. The formula is inferred from the published
    split, which comes without one.
    """

    def of(period: str, status: str, column: str):
        chosen = (F.col("period") == period) & (F.col("delivery_status") == status)
        return F.coalesce(F.sum(F.when(chosen, F.col(column))), F.lit(0))

    totals = counts.agg(
        *[
            of(period, status, column).alias(f"{column}_{status}_{i}")
            for i, period in enumerate((base, following))
            for status in ("late", "on_time")
            for column in ("reviewed_orders", "low_score_orders")
        ]
    )

    def rate(i: int, status: str):
        return ratio(f"low_score_orders_{status}_{i}", f"reviewed_orders_{status}_{i}")

    def share(i: int):
        reviewed = F.col(f"reviewed_orders_late_{i}") + F.col(f"reviewed_orders_on_time_{i}")
        return ratio(f"reviewed_orders_late_{i}", reviewed)

    def overall(i: int):
        hits = F.col(f"low_score_orders_late_{i}") + F.col(f"low_score_orders_on_time_{i}")
        reviewed = F.col(f"reviewed_orders_late_{i}") + F.col(f"reviewed_orders_on_time_{i}")
        return ratio(hits, reviewed)

    return totals.select(
        (overall(1) - overall(0)).alias("change"),
        ((share(1) - share(0)) * (rate(0, "late") - rate(0, "on_time"))).alias("mix"),
    ).withColumn("within_group", F.col("change") - F.col("mix"))


def low_score_decomposition(t: Tables, s: Settings) -> DataFrame:
    """How much of the change in the low-score rate is mix shift."""
    change = F.nullif(F.col("change"), F.lit(0.0))
    return decompose_change(
        period_status_counts(t, s), s.base_period.short_name, s.next_period.short_name
    ).select(
        rounded(100.0 * F.col("change"), 4).alias("change_pp"),
        rounded(100.0 * F.col("mix"), 4).alias("mix_pp"),
        rounded(100.0 * F.col("within_group"), 4).alias("within_pp"),
        rounded(100.0 * F.col("mix") / change).alias("mix_share_pct"),
        rounded(100.0 * F.col("within_group") / change).alias("within_share_pct"),
    )
