"""Source tables derived from the benchmark's star-schema Parquet files.

The benchmark data has no delivery, promise, carrier or review columns, so
they are computed from order and customer keys with fixed formulas. Each
derived table is one narrow scan of the file it comes from.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivered import is_delivered, is_late
from ..settings import DateRange, Period, Settings
from .lazy_tables import LazyTables

# Ranges and thresholds that fit the benchmark's dates and sizes.
BENCHMARK_SETTINGS = Settings(
    analysis=DateRange(date(2000, 1, 1), date(2001, 9, 1)),
    review_coverage=DateRange(date(2000, 1, 1), date(2001, 7, 1)),
    quarters=DateRange(date(2000, 10, 1), date(2001, 4, 1)),
    base_period=Period("Jan-Jun 2000", "2000", DateRange(date(2000, 1, 1), date(2000, 7, 1))),
    next_period=Period("Jan-Jun 2001", "2001", DateRange(date(2001, 1, 1), date(2001, 7, 1))),
    buffer_days=11.0,
    batch_min_orders=2,
    batch_min_purchase_spread=14,
    batch_min_days_late=10,
)


def orders(source: DataFrame) -> DataFrame:
    """Orders bought at some second of their (midnight) order date."""
    return (
        source.selectExpr(
            "o_orderkey AS k",
            "o_custkey AS ck",
            "o_orderdate AS day",
            "o_orderkey * 7919 % 86400 AS bought",
            "CASE WHEN o_orderstatus <> 'P' THEN 'delivered'"
            " WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'shipped' END AS status",
        )
        .selectExpr("*", "bought + 3600 * (k * 37 % 240 - 4) AS handed")
        .selectExpr(
            "k AS order_id",
            "ck AS customer_id",
            "status AS order_status",
            "timestampadd(SECOND, bought, day) AS order_purchase_timestamp",
            "CASE WHEN k % 613 <> 0 THEN timestampadd(SECOND, bought + 3600 * (k % 48), day) END"
            " AS order_approved_at",
            "CASE WHEN k % 997 <> 1 THEN timestampadd(SECOND, handed, day) END"
            " AS order_delivered_carrier_date",
            "CASE WHEN status = 'delivered' AND k % 499 <> 0 THEN timestampadd(SECOND, handed"
            " + 3600 * (k * 101 % 480 + ck % 7 * 12"
            " + if(month(to_date(day)) IN (2, 3, 11), 72, 0) - if(k % 331 = 0, 600, 0)),"
            " day) END AS order_delivered_customer_date",
            "CAST(date_add(to_date(day), CAST(18 + k * 13 % 24 AS INT)) AS TIMESTAMP_NTZ)"
            " AS order_estimated_delivery_date",
        )
    )


def order_reviews(shop_orders: DataFrame) -> DataFrame:
    """Zero, one or two reviews of every delivered order."""
    return (
        shop_orders.where(is_delivered())
        .select(
            F.col("order_id").alias("k"),
            F.col("order_delivered_customer_date").alias("arrived"),
            is_late().alias("late"),
            F.explode(F.array(F.lit(0), F.lit(1))).alias("n"),
        )
        .where("(n = 0 AND k % 130 <> 0) OR (n = 1 AND k % 180 = 0)")
        .selectExpr(
            "k * 10 + n AS review_id",
            "k AS order_id",
            "CAST(CASE WHEN late THEN 1 + (k * 17 + n) % 4"
            " WHEN k * 13 % 100 < 9 THEN 1 + (k * 17 + n) % 2"
            " ELSE 3 + (k * 17 + n) % 3 END AS INT) AS review_score",
            "CASE WHEN k % 8 = 0 THEN concat('title ', k) END AS review_comment_title",
            "CASE WHEN k % 5 < 2 THEN concat('message ', k) END AS review_comment_message",
            "CAST(to_date(arrived) AS TIMESTAMP_NTZ) AS review_creation_date",
            "CASE WHEN n = 1 OR k % 360 <> 0 THEN"
            " timestampadd(HOUR, k % 72 + n * 24, arrived) END AS review_answer_timestamp",
        )
    )


def order_items(source: DataFrame) -> DataFrame:
    return source.selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "CASE WHEN l_suppkey = 1 AND l_orderkey % 97 <> 0 THEN 2L ELSE l_suppkey END AS seller_id",
        "l_shipdate AS shipping_limit_date",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS price",
        "CAST(l_quantity AS DECIMAL(12,2)) AS freight_value",
    )


def order_payments(source: DataFrame) -> DataFrame:
    """One payment per order, and a second one for some."""
    return (
        source.selectExpr("o_orderkey AS k", "o_totalprice AS total", "explode(array(1, 2)) AS n")
        .where("n = 1 OR k % 20 = 0")
        .selectExpr(
            "k AS order_id",
            "n AS payment_sequential",
            "CASE k % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher'"
            " ELSE 'debit_card' END AS payment_type",
            "CAST(1 + k % 10 AS INT) AS payment_installments",
            "CAST(if(n = 1, total, 10D) AS DECIMAL(12,2)) AS payment_value",
        )
    )


def products(source: DataFrame) -> DataFrame:
    return source.selectExpr(
        "p_partkey AS product_id",
        "CASE WHEN p_partkey % 53 <> 0 THEN p_brand END AS product_category_name",
        "CAST(CASE WHEN p_partkey % 53 <> 0 THEN length(p_name) END AS DECIMAL(10,0))"
        " AS product_name_lenght",
        "CAST(CASE WHEN p_partkey % 53 <> 0 THEN length(p_type) END AS DECIMAL(10,0))"
        " AS product_description_lenght",
        "CAST(CASE WHEN p_partkey % 53 <> 0 THEN p_partkey % 5 + 1 END AS DECIMAL(10,0))"
        " AS product_photos_qty",
        "CAST(CASE WHEN p_partkey % 97 <> 0 THEN p_size * 100 END AS DECIMAL(12,2))"
        " AS product_weight_g",
        "CAST(CASE WHEN p_partkey % 97 <> 0 THEN p_partkey % 50 + 10 END AS DECIMAL(12,2))"
        " AS product_length_cm",
        "CAST(CASE WHEN p_partkey % 89 <> 0 THEN p_partkey % 30 + 5 END AS DECIMAL(12,2))"
        " AS product_height_cm",
        "CAST(CASE WHEN p_partkey % 97 <> 0 THEN p_partkey % 40 + 8 END AS DECIMAL(12,2))"
        " AS product_width_cm",
    )


def category_translation(source: DataFrame) -> DataFrame:
    """English names of all categories but one."""
    return (
        source.where("p_brand <> 'Brand#7'")
        .select("p_brand")
        .distinct()
        .selectExpr(
            "p_brand AS product_category_name", "upper(p_brand) AS product_category_name_english"
        )
    )


def customers(source: DataFrame, nation: DataFrame) -> DataFrame:
    return source.join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_custkey AS customer_id",
        "c_custkey - c_custkey % 2 AS customer_unique_id",
        "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS customer_zip_code_prefix",
        "lower(c_mktsegment) AS customer_city",
        "n_name AS customer_state",
    )


def sellers(source: DataFrame, nation: DataFrame) -> DataFrame:
    return source.join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "s_suppkey AS seller_id",
        "lpad(CAST(s_suppkey % 100000 AS STRING), 5, '0') AS seller_zip_code_prefix",
        "lower(s_name) AS seller_city",
        "n_name AS seller_state",
    )


def geolocation(source: DataFrame, nation: DataFrame) -> DataFrame:
    return source.join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS geolocation_zip_code_prefix",
        "-33D + c_custkey % 380 / 10D AS geolocation_lat",
        "-73D + c_custkey % 390 / 10D AS geolocation_lng",
        "lower(c_mktsegment) AS geolocation_city",
        "n_name AS geolocation_state",
    )


# Columns read from the benchmark files; stating them saves a schema-reading job per file.
_FILES = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz",
}


def raw_tables(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """The nine source tables, before cleaning."""
    files = LazyTables(
        {
            name: lambda name=name, columns=columns: spark.read.schema(columns).parquet(
                f"{folder.rstrip('/')}/{name}.parquet"
            )
            for name, columns in _FILES.items()
        }
    )
    shop = LazyTables(
        {
            "customers": lambda: customers(files["customer"], files["nation"]),
            "sellers": lambda: sellers(files["supplier"], files["nation"]),
            "products": lambda: products(files["part"]),
            "category_translation": lambda: category_translation(files["part"]),
            "orders": lambda: orders(files["orders"]),
            "order_items": lambda: order_items(files["lineitem"]),
            "order_payments": lambda: order_payments(files["orders"]),
            "order_reviews": lambda: order_reviews(shop["orders"]),
            "geolocation": lambda: geolocation(files["customer"], files["nation"]),
        }
    )
    return shop
