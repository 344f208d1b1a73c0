"""Cleaning of the raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.medians import middle_values
from ..sources.lazy_tables import LazyTables
from ..sources.tables import (
    ALL_TABLES,
    ENGLISH_CATEGORY,
    ORDER_REVIEWS,
    ORDERS,
    Table,
)

UNKNOWN = "unknown"
# Measures whose gaps are filled with the median.
IMPUTED = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
# A mean of two 2-digit decimals needs a third digit.
IMPUTED_TYPE = "decimal(13,3)"


def parse_moments(df: DataFrame, table: Table) -> DataFrame:
    """Text columns declared as timestamps become timestamps; malformed text becomes NULL."""
    parsed = {
        name: F.col(name).try_cast("timestamp_ntz")
        for name in table.moments
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
    }
    return df.withColumns(parsed) if parsed else df


def clean_orders(orders: DataFrame) -> DataFrame:
    """Parse every timestamp. Missing events stay NULL: they never happened."""
    return parse_moments(orders, ORDERS)


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """One review per order: the one answered last.

    A review without an answer time counts as last, and equal times are
    decided by ``review_id``. Spark limits each group to one row before the
    shuffle as well as after it, so an order with very many reviews sends one
    row per task.
    """
    latest_first = Window.partitionBy("order_id").orderBy(
        F.col("review_answer_timestamp").desc_nulls_first(), F.col("review_id").desc_nulls_last()
    )
    return (
        parse_moments(reviews, ORDER_REVIEWS)
        .withColumn("recency", F.row_number().over(latest_first))
        .where("recency = 1")
        .drop("recency")
    )


def translate_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Fill missing categories and add their English names, both ``unknown`` when absent."""
    return (
        products.withColumn(
            "product_category_name", F.coalesce("product_category_name", F.lit(UNKNOWN))
        )
        .join(
            translation.select("product_category_name", ENGLISH_CATEGORY),
            "product_category_name",
            "left",
        )
        .withColumn(ENGLISH_CATEGORY, F.coalesce(ENGLISH_CATEGORY, F.lit(UNKNOWN)))
        .select(*products.columns, ENGLISH_CATEGORY)
    )


def _in_hundredths(measure: str) -> Column:
    """A 2-digit decimal as an integer."""
    return (F.col(measure) * 100).cast("bigint")


def _median(lower: Column, upper: Column) -> Column:
    """Mean of two middle values held in hundredths."""
    return ((lower + upper).cast("decimal(20,0)") / F.lit(200).cast("decimal(3,0)")).cast(
        IMPUTED_TYPE
    )


def measure_medians(
    products: DataFrame, measures: Sequence[str], by: str | None = None
) -> DataFrame:
    """Exact median of each measure as one struct column, over all products or per group.

    The measures are stacked into rows, so all of them share the same passes.
    """
    keys = [] if by is None else [by]
    stacked = products.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), _in_hundredths(m).alias("v"))
                    for m in measures
                ]
            )
        ),
    )
    middle = middle_values(
        stacked,
        "v",
        keys=[*keys, "measure"],
        groups_at_most=len(measures) if by is None else None,
    )
    median = _median(F.col("lower"), F.col("upper"))
    return middle.groupBy(*keys).agg(
        F.struct(
            *[F.max(F.when(F.col("measure") == m, median)).alias(m) for m in measures]
        ).alias("medians")
    )


def impute_medians(
    products: DataFrame, measures: Sequence[str] = IMPUTED, by: str | None = None
) -> DataFrame:
    """Fill missing measures with the median over all products, or within a group.

    ``by`` names the grouping column; a group without any value of a measure
    keeps its NULLs.
    """
    medians = measure_medians(products, measures, by)
    if by is None:
        source, found = products, medians.scalar()
    else:
        source, found = products.join(medians, by, "left"), F.col("medians")
    filled = {m: F.coalesce(F.col(m).cast(IMPUTED_TYPE), found.getField(m)) for m in measures}
    return source.withColumns(filled).select(*products.columns)


def clean_products(
    products: DataFrame, translation: DataFrame, impute_by: str | None = None
) -> DataFrame:
    """Fill and translate categories, then fill missing measures with medians."""
    return impute_medians(translate_categories(products, translation), by=impute_by)


def clean_all(
    raw: Mapping[str, DataFrame], impute_by: str | None = None
) -> Mapping[str, DataFrame]:
    """Every table in its cleaned form."""
    builders = {
        name: partial(lambda name, table: parse_moments(raw[name], table), name, table)
        for name, table in ALL_TABLES.items()
        if name in raw
    }
    builders["order_reviews"] = lambda: clean_reviews(raw["order_reviews"])
    builders["products"] = lambda: clean_products(
        raw["products"], raw["category_translation"], impute_by=impute_by
    )
    return LazyTables(builders)
