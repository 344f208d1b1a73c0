"""The batch job: read, audit, clean, check, save or publish."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_all
from ..operators.quality import ScanAudit, profile, require_unique, row_changes, shared_measures
from ..session import use_checkpoint_dir
from ..settings import Settings
from ..sources.batches import now
from ..sources.csv_files import parsed, rejected_values
from ..sources.parquet_files import (
    commit, commit_all, discard, footer_tables, load_all, new_batch, save_table, table_path,
)
from ..sources.tables import ALL_TABLES, ORDER_REVIEWS
from ..sources.warehouse import publish, published_form, published_tables
from .catalogue import AUDITS

log = logging.getLogger(__name__)


class MalformedNumbersError(ValueError):
    """A source file holds values that are no numbers."""


QUARANTINE, PROFILE = "quarantine", "profile"


def audit(raw: Mapping[str, DataFrame], folder: str, settings: Settings | None = None) -> None:
    """Save every audit of the raw tables as ``folder/NAME.parquet``.

    The audits that need one pass over a table share it: their measures are saved
    as ``folder/profile.parquet`` first. The others look at keys and references.
    """
    settings = settings or Settings()
    scanning = {name: query for name, query in AUDITS.items() if isinstance(query, ScanAudit)}
    path = table_path(folder, PROFILE)
    measured = profile(raw, shared_measures(scanning.values(), raw, settings))
    measured.write.mode("overwrite").parquet(path)
    measured = measured.sparkSession.read.parquet(path)
    for name, query in AUDITS.items():
        found = query.findings(measured, settings) if name in scanning else query(raw, settings)
        found.repartition(1).write.mode("overwrite").parquet(table_path(folder, name))


def ingest(spark: SparkSession, source_folder: str, target_folder: str, allow_malformed: bool = False) -> int:
    """Parse the files, once, into a new batch of ``target_folder/raw``; the number of malformed values.

    Malformed values become NULL, are counted by column during that pass and kept,
    with table, column and file, in ``target_folder/quarantine.parquet``. Without
    ``allow_malformed`` a malformed number stops the job and nothing stays behind;
    a malformed timestamp never does.
    """
    target = target_folder.rstrip("/")
    tables = [parsed(spark, source_folder, table) for table in ALL_TABLES.values()]  # all files are there
    batch = new_batch(f"{target}/raw")
    try:
        malformed = {}
        for part in tables:
            save_table(part.table.name, part.rows, batch)
            malformed[part.table.name] = part.malformed()
        numbers = [
            f"{part.table.name}.{column}: {n}"
            for part in tables
            for column, n in malformed[part.table.name].items()
            if column in part.numbers
        ]
        if numbers and not allow_malformed:
            raise MalformedNumbersError(f"values that are no numbers: {', '.join(numbers)}")
    except BaseException:
        discard(spark, batch)
        raise
    for name, columns in malformed.items():
        for column, n in columns.items():
            log.warning("%s.%s: %d malformed values", name, column, n)
    # only the tables that have any are read again, and of these one column
    found = [n for n in ALL_TABLES if malformed[n]]
    parts = [rejected_values(n, spark.read.parquet(table_path(batch, n))) for n in found]
    empty = spark.createDataFrame([], "table_name string, column_name string, value string, file string")
    reduce(DataFrame.unionByName, parts, empty).write.mode("overwrite").parquet(table_path(target, QUARANTINE))
    commit(spark, batch)
    return sum(n for columns in malformed.values() for n in columns.values())


def saved_rows(spark: SparkSession, target_folder: str) -> DataFrame:
    """What cleaning did to the number of rows of each table, raw against saved, from the files' footers alone."""
    target = target_folder.rstrip("/")
    return row_changes(footer_tables(spark, f"{target}/raw"), footer_tables(spark, target))


def run(
    spark: SparkSession,
    source_folder: str,
    target_folder: str,
    database: str | None = None,
    batch: str | None = None,
    impute_by: str | None = None,
    buckets: Mapping[str, tuple[str, int]] | None = None,
    settings: Settings | None = None,
    allow_malformed: bool = False,
) -> dict[str, DataFrame]:
    """Turn a folder of CSV files into checked tables and return them.

    The files are parsed once, by `ingest`, into ``target_folder/raw``, where the
    audits (saved in ``target_folder/audits``) and the cleaning read them; small row
    counts are reported. Reviews that still repeat an order after cleaning stop the
    job before a cleaned table is saved. The cleaned tables are written once:
    published in ``database`` if it is given, else committed in ``target_folder``.
    """
    raw_folder, findings = (f"{target_folder.rstrip('/')}/{part}" for part in ("raw", "audits"))
    ingest(spark, source_folder, target_folder, allow_malformed)
    raw = load_all(spark, raw_folder)

    audit(raw, findings, settings)
    for row in spark.read.parquet(table_path(findings, "audit_row_counts")).toLocalIterator():
        log.info("read %s: %d rows, %d columns", *row)
    for row in spark.read.parquet(table_path(findings, "audit_row_floors")).toLocalIterator():
        level = logging.INFO if row["status"] == "passed" else logging.WARNING
        log.log(level, "%s: %d rows, %s", row["table_name"], row["row_count"], row["status"])

    cleaned = dict(clean_all(raw, impute_by=impute_by))
    # Both the uniqueness check and the save need the deduplicated reviews.
    use_checkpoint_dir(spark)
    cleaned["order_reviews"] = cleaned["order_reviews"].checkpoint()
    require_unique(cleaned["order_reviews"], ORDER_REVIEWS.key, ORDER_REVIEWS.name)

    if database is None:
        ready = {name: published_form(name, df) for name, df in cleaned.items()}
        commit_all(spark, ready, target_folder.rstrip("/"))
        for row in saved_rows(spark, target_folder).toLocalIterator():
            log.info("saved %s: %d of %d rows", row["table_name"], row["rows_after"], row["rows_before"])
        return load_all(spark, target_folder)
    publish(spark, cleaned, database, batch or now(), buckets)
    return published_tables(spark, database)
