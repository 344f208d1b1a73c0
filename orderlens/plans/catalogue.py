"""Every query by name. Each takes the cleaned tables and the settings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ..operators import quality
from ..operators.delivered import delivered_orders
from ..settings import Settings
from . import business_cases, chart_data, kpis, reported_kpis, statistics

Tables = Mapping[str, DataFrame]
Query = Callable[[Tables, Settings], DataFrame]

QUERIES: dict[str, Query] = {
    "delivered_orders": lambda t, s: delivered_orders(t["orders"]),
    # Business questions.
    "baseline_kpis": kpis.baseline_kpis,
    "late_delivery_rate": kpis.late_delivery_rate,
    "state_performance": kpis.state_performance,
    "delay_vs_review": kpis.delay_vs_review,
    "state_confounding": kpis.state_confounding,
    "monthly_trend": kpis.monthly_trend,
    "seller_vs_carrier": kpis.seller_vs_carrier,
    "promised_vs_actual": kpis.promised_vs_actual,
    "seller_late_rate": kpis.seller_late_rate,
    "category_analysis": kpis.category_analysis,
    # Business cases.
    "gmv_by_purchase_quarter": business_cases.gmv_by_purchase_quarter,
    "gmv_by_delivery_quarter": business_cases.gmv_by_delivery_quarter,
    "review_coverage": business_cases.review_coverage,
    "low_score_by_period": business_cases.low_score_by_period,
    "late_by_period": business_cases.late_by_period,
    "low_score_period_x_status": business_cases.low_score_period_x_status,
    # Chart datasets.
    "monthly_late_rate": chart_data.monthly_late_rate,
    "review_score_distribution": chart_data.review_score_distribution,
    "monthly_buffer_vs_late": chart_data.monthly_buffer_vs_late,
    # Reported measures.
    "late_rate_by_definition": reported_kpis.late_rate_by_definition,
    "repeat_purchase_rate": reported_kpis.repeat_purchase_rate,
    "carrier_share": reported_kpis.carrier_share,
    "buffer_threshold": reported_kpis.buffer_threshold,
    "category_weight_correlation": reported_kpis.category_weight_correlation,
    "period_growth": reported_kpis.period_growth,
    # Statistics.
    "buffer_late_correlation": statistics.buffer_late_correlation,
    "buffer_late_significance": statistics.buffer_late_significance,
    "buffer_late_line": statistics.buffer_late_line,
    "state_late_rate_interval": statistics.state_late_rate_interval,
    "low_score_z_test": statistics.low_score_z_test,
    "low_score_decomposition": statistics.low_score_decomposition,
}

# Audits of the tables as they arrive, before cleaning.
AUDITS: dict[str, Query] = {
    "audit_row_counts": quality.ROW_COUNTS,
    "audit_row_floors": quality.row_floor_audit(),
    "audit_duplicate_reviews": lambda t, s: quality.duplicate_rows(t["order_reviews"], ["order_id"]),
    "audit_primary_keys": lambda t, s: quality.primary_keys(t),
    "audit_required_columns": quality.REQUIRED_COLUMNS,
    "audit_foreign_keys": lambda t, s: quality.foreign_keys(t),
    "audit_null_profile": quality.NULL_PROFILE,
    "audit_missing_together": quality.CATALOGUE_GAPS,
    "audit_missing_groups": lambda t, s: quality.missing_groups(t),
    "audit_unreviewed_orders": lambda t, s: quality.unreviewed_orders(t),
    "audit_itemless_orders": lambda t, s: quality.itemless_orders(t),
    "audit_undated_deliveries": quality.UNDATED_DELIVERIES,
    "audit_impossible_durations": quality.IMPOSSIBLE_DURATIONS,
    "audit_batch_deliveries": quality.batch_deliveries,
    "audit_customer_identity": lambda t, s: quality.customer_identity(t),
    "audit_key_relations": lambda t, s: quality.key_relations(t),
    "audit_window_coverage": quality.WINDOW_COVERAGE,
}

# Audits that need no more of a table than its number of rows.
COUNTING = frozenset({"audit_row_counts", "audit_row_floors"})
