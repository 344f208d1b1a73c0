"""Command line: ``load`` CSV files into checked tables, ``query`` saved, published or raw tables.

    spark-submit ... -m orderlens load SOURCE TARGET [--database NAME] [--batch NAME] [--buckets N]
    spark-submit ... -m orderlens query NAME --tables FOLDER | --database NAME | --source FOLDER
                                        [--output FOLDER]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .operators.cleaning import parse_moments
from .plans import etl_job
from .plans.catalogue import AUDITS, COUNTING, QUERIES
from .session import PARTITION_BYTES, SETTINGS, shuffle_settings, size_shuffles, stored_bytes
from .settings import Settings
from .sources.csv_files import read_all
from .sources.parquet_files import footer_tables, load_all
from .sources.tables import ALL_TABLES
from .sources.warehouse import order_buckets, published_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orderlens", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="read, audit, clean, check, save or publish")
    load.add_argument("source")
    load.add_argument("target")
    load.add_argument("--database")
    load.add_argument("--batch")
    load.add_argument("--impute-by")
    load.add_argument(
        "--allow-malformed", action="store_true", help="malformed numbers become NULL instead of stopping the load"
    )
    load.add_argument(
        "--buckets", type=int, help="buckets of published facts on order_id; 0: none, default: by size"
    )
    query = commands.add_parser("query", help="print or save a query")
    query.add_argument("name", choices=[*QUERIES, *AUDITS])
    tables = query.add_mutually_exclusive_group(required=True)
    tables.add_argument("--tables", help="folder of saved tables; TARGET/raw for audits")
    tables.add_argument("--database", help="published tables")
    tables.add_argument("--source", help="folder of CSV files, for audits")
    query.add_argument("--rows", type=int, default=50, help="rows to print")
    query.add_argument("--output", help="folder for the full result, as Parquet")
    for command in (load, query):
        command.add_argument("--shuffled-gb", type=int, help="size of the largest shuffle, default: by size")
    args = parser.parse_args(argv)

    logging.basicConfig(level=logging.INFO)
    builder = SparkSession.builder.appName("orderlens")
    for key, value in {**SETTINGS, **shuffle_settings((args.shuffled_gb or 0) << 30)}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    folder = args.source or getattr(args, "tables", None)
    stored = stored_bytes(spark, folder) if folder else 0
    if args.shuffled_gb is None and folder:
        size_shuffles(spark, stored)
    if args.command == "load":
        count = -(-stored // PARTITION_BYTES) if args.buckets is None else args.buckets
        etl_job.run(
            spark, args.source, args.target, args.database, args.batch,
            impute_by=args.impute_by, buckets=order_buckets(count) if count else None,
            allow_malformed=args.allow_malformed,
        )
        return
    result = {**QUERIES, **AUDITS}[args.name](_tables(spark, args), Settings())
    if args.output:
        result.write.mode("overwrite").parquet(args.output)
    else:
        result.show(args.rows, truncate=False)


def _tables(spark: SparkSession, args: argparse.Namespace):
    if args.database:
        return published_tables(spark, args.database)
    if args.source:
        raw = read_all(spark, args.source)
        return {name: parse_moments(df, ALL_TABLES[name]) for name, df in raw.items()}
    return (footer_tables if args.name in COUNTING else load_all)(spark, args.tables)


if __name__ == "__main__":
    main()
