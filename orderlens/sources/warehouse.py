"""Publishing tables to the catalog, and naming them for SQL users."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.delivered import delivered_orders
from . import batches, monthly
from .batches import current_database
from .batches import switch as _switch
from .tables import ALL_TABLES, published_columns

DELIVERED_VIEW = "v_delivered_orders"


class MissingColumnsError(ValueError):
    """A table lacks columns its published form needs."""


def published_form(name: str, df: DataFrame) -> DataFrame:
    """The declared columns in declared order, extras dropped; raises if any is missing."""
    wanted = published_columns(ALL_TABLES[name])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{name}: columns missing: {missing}")
    return df.select(*wanted)


def order_buckets(count: int) -> dict[str, tuple[str, int]]:
    """The fact tables bucketed alike on their order, so joins between them need no shuffle.

    Leave a table out if one order holds a large share of its rows: a bucket is one task.
    """
    return {name: ("order_id", count) for name in ("orders", "order_items", "order_reviews")}


def publish(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    database: str,
    batch: str,
    buckets: Mapping[str, tuple[str, int]] | None = None,
    keep_batches: int = 2,
) -> None:
    """Write the tables and the delivered-order view into a database of their own, then switch to it.

    The batch goes to ``database__batch``, which must not exist. All columns are
    checked before anything is written, and a property of ``database`` names the
    current batch: setting it is the one switch, so readers see all of the old batch
    or all of the new one. ``buckets`` maps a table to (column, count). The last
    ``keep_batches`` published ones and the current one stay; databases that
    `publish` did not make are never dropped.
    """
    ready = {name: published_form(name, tables[name]) for name in ALL_TABLES}
    home = batches.begin(spark, database, batch)
    for name, df in ready.items():
        _write_table(df, home, name, (buckets or {}).get(name))
    complete(spark, database, batch, keep_batches)


def _write_table(df: DataFrame, home: str, name: str, bucket: tuple[str, int] | None = None) -> None:
    writer = df.write
    if bucket:
        column, count = bucket
        writer = df.repartition(count, column).write.bucketBy(count, column).sortBy(column)
    elif name == "orders":
        writer = df.sortWithinPartitions("order_purchase_timestamp").write
    writer.format("parquet").saveAsTable(f"`{home}`.`{name}`")


def complete(spark: SparkSession, database: str, batch: str, keep_batches: int) -> None:
    """Add the view and functions to a written batch, switch to the batch and drop those out of date."""
    home = f"{database}__{batch}"
    spark.sql(f"CREATE VIEW `{home}`.`{DELIVERED_VIEW}` AS {_DELIVERED_SQL.format(home=home)}")
    for name, (columns, body) in _FUNCTIONS.items():
        header = f"CREATE FUNCTION `{home}`.`{name}`(first_day DATE, end_day DATE) RETURNS TABLE ({columns})"
        spark.sql(f"{header} RETURN {body.format(home=home)}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    batches.finish(spark, home)
    _switch(spark, database, batch)
    old = batches.outdated(batches.own_batches(spark, database), home, keep_batches)
    monthly.drop_batches(spark, database, old)


# The columns and conditions of `delivered_orders`, as a catalog view can only be SQL; a test holds the two equal.
_DELIVERED_SQL = """
SELECT order_id, customer_id, order_purchase_timestamp, order_delivered_customer_date,
       order_estimated_delivery_date,
       CAST(order_delivered_customer_date AS DATE) > CAST(order_estimated_delivery_date AS DATE) AS is_late,
       CAST(CAST(CAST(CAST(order_delivered_customer_date - order_purchase_timestamp AS INTERVAL SECOND)
            AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS DOUBLE) / 86400000000D AS delivery_days
FROM `{home}`.`orders`
WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
"""

# Table functions for SQL users: orders bought from ``first_day`` to the day before ``end_day``. Spark takes
# no database in such a call, so users say ``USE`` first. The trend equals `kpis.monthly_trend`, held by a test.
_FUNCTIONS = {
    "delivered_between": (
        "order_id STRING, customer_id STRING, order_purchase_timestamp TIMESTAMP_NTZ,"
        " order_delivered_customer_date TIMESTAMP_NTZ, order_estimated_delivery_date TIMESTAMP_NTZ,"
        " is_late BOOLEAN, delivery_days DOUBLE",
        f"""
SELECT * FROM `{{home}}`.`{DELIVERED_VIEW}`
WHERE order_purchase_timestamp >= first_day AND order_purchase_timestamp < end_day
""",
    ),
    "monthly_trend": (
        "month DATE, delivered_orders BIGINT, gmv DECIMAL(21,2), gmv_mom_growth_pct DOUBLE, late_rate_pct DOUBLE",
        f"""
SELECT month, delivered_orders, gmv,
       CAST(ROUND(CAST(100D * CAST(gmv - before AS DOUBLE) / NULLIF(CAST(before AS DOUBLE), 0D)
            AS DECIMAL(38,8)), 2) AS DOUBLE) AS gmv_mom_growth_pct,
       CAST(ROUND(CAST(late_rate AS DECIMAL(38,8)), 2) AS DOUBLE) AS late_rate_pct
FROM (
  SELECT *, LAG(gmv) OVER (PARTITION BY 0 ORDER BY month) AS before
  FROM (
    SELECT TRUNC(CAST(order_purchase_timestamp AS DATE), 'month') AS month, COUNT(*) AS delivered_orders,
           CAST(CAST(SUM(cents) AS DECIMAL(19,0)) * 0.01BD AS DECIMAL(21,2)) AS gmv,
           100D * COUNT_IF(is_late) / NULLIF(CAST(COUNT(is_late) AS DOUBLE), 0D) AS late_rate
    FROM `{{home}}`.`{DELIVERED_VIEW}`
    JOIN (
      SELECT order_id, SUM(CAST((price + freight_value) * 100 AS BIGINT)) AS cents
      FROM `{{home}}`.`order_items` GROUP BY order_id
    ) USING (order_id)
    WHERE order_purchase_timestamp >= first_day AND order_purchase_timestamp < end_day
    GROUP BY 1
  )
)
""",
    ),
}


def published_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The current batch of every published table."""
    home = current_database(spark, database)
    return {name: spark.table(f"`{home}`.`{name}`") for name in ALL_TABLES}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Name the tables and the delivered-order view for ``spark.sql`` in this session."""
    for name in ALL_TABLES:
        if name in tables:
            tables[name].createOrReplaceTempView(name)
    delivered_orders(tables["orders"]).createOrReplaceTempView(DELIVERED_VIEW)
