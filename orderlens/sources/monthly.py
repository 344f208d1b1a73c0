"""Published facts by month of purchase, of which single months can be replaced.

The facts of a batch are tables partitioned by the month in which their order was
bought. Their files lie in the folder of the public database, outside the
batch's own database. A batch that replaces some months writes only these; its
other partitions refer to the files of the batch before, so nothing is copied,
and the switch of batches shows all replaced months of all tables at once. Files
are deleted when the last batch that refers to them is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, folders, warehouse
from .tables import ALL_TABLES

MONTH = "purchase_month"
# Month of rows whose order is unknown or has no purchase time.
NO_MONTH = "none"
FACTS = ("orders", "order_items", "order_payments", "order_reviews")
# Tasks that write a month of a table.
SPLITS = 8


def by_month(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The facts with the month of their order; equal order ids count once, with the first month."""
    month = F.coalesce(F.date_format("order_purchase_timestamp", "yyyy-MM"), F.lit(NO_MONTH))
    orders = tables["orders"].withColumn(MONTH, month)
    months = orders.groupBy("order_id").agg(F.min(MONTH).alias(MONTH))
    found = {"orders": orders.drop(MONTH).join(months, "order_id", "left")}
    for name in FACTS[1:]:
        found[name] = tables[name].join(months, "order_id", "left")
    declared = {name: warehouse.published_form(name, df).columns for name, df in tables.items() if name in FACTS}
    kept = F.coalesce(MONTH, F.lit(NO_MONTH)).alias(MONTH)
    return {name: df.select(*declared[name], kept) for name, df in found.items()}


def publish_months(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    database: str,
    batch: str,
    months: Iterable[str] | None = None,
    keep_batches: int = 2,
) -> None:
    """Publish a batch by months, or with ``months`` (``2018-03``) one that replaces only these.

    Of the facts in ``tables`` only rows of the given months are used, and these
    months then hold nothing else: one without rows is emptied. All other months
    are those of the current batch, which must have been published by months.
    The other tables are replaced whole. Readers see one batch or the other.
    """
    wanted = None if months is None else sorted(set(months))
    ready = {n: warehouse.published_form(n, tables[n]) for n in ALL_TABLES if n not in FACTS}
    facts = by_month({name: tables[name] for name in FACTS})
    before = None if wanted is None else batches.current_database(spark, database)
    old = {name: partitions(spark, before, name) for name in FACTS} if before else {}
    if before and any(found is None for found in old.values()):
        raise ValueError(f"{before} was not published by months")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    home = batches.begin(spark, database, batch)
    for name, df in ready.items():
        warehouse._write_table(df, home, name)
    for name, df in facts.items():
        if wanted is not None:
            df = df.where(F.col(MONTH).isin(wanted))
        split = F.pmod(F.xxhash64("order_id"), F.lit(SPLITS))
        spread = df.repartition(F.col(MONTH), split)
        order = [MONTH, "order_purchase_timestamp"] if name == "orders" else [MONTH, "order_id"]
        path = f"{_store(spark, database)}/{batch}/{name}"
        writer = spread.sortWithinPartitions(*order).write.partitionBy(MONTH).option("path", path)
        writer.format("parquet").saveAsTable(f"`{home}`.`{name}`")
        for month, place in (old.get(name) or {}).items():
            if month not in wanted:
                spec = f"{MONTH} = '{month}'"
                spark.sql(f"ALTER TABLE `{home}`.`{name}` ADD PARTITION ({spec}) LOCATION '{place}'")
    warehouse.complete(spark, database, batch, keep_batches)


def _store(spark: SparkSession, database: str) -> str:
    return f"{batches.location(spark, database)}/months"


def partitions(spark: SparkSession, home: str, name: str) -> dict[str, str] | None:
    """Where the files of each month of a published table lie; None if it is not kept by months."""
    table = f"`{home}`.`{name}`"
    if MONTH not in spark.table(table).columns:
        return None
    found = {}
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():  # one row a month
        month = row[0].split("=", 1)[1]
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {table} PARTITION ({MONTH} = '{month}')").collect()
        found[month] = next(r[1] for r in described if r[0] == "Location")
    return found


def _places(spark: SparkSession, home: str) -> set[str]:
    """Where a batch's months lie; of a batch that failed, those it came to write."""
    found: set[str] = set()
    for name in FACTS:
        if spark.catalog.tableExists(f"`{home}`.`{name}`"):
            found.update((partitions(spark, home, name) or {}).values())
    return found


def drop_batches(spark: SparkSession, database: str, old: list[batches.Batch]) -> None:
    """Drop the databases and the files of months that no other batch refers to."""
    if not old:
        return
    gone = {batch.home for batch in old}
    left: set[str] = set()
    for batch in batches.own_batches(spark, database):
        if batch.home not in gone:
            left |= _places(spark, batch.home)
    store = _store(spark, database)
    for batch in old:
        unused = _places(spark, batch.home) - left
        spark.sql(f"DROP DATABASE `{batch.home}` CASCADE")
        for place in unused:
            folders.delete(spark, place)
        own = f"{store}/{batch.home.removeprefix(f'{database}__')}"
        if not any(f"{own}/" in place for place in left):
            folders.delete(spark, own)
