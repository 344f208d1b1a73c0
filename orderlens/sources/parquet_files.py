"""Parquet copies of the tables, one folder per table.

`commit_all` writes all tables of a batch into a folder of their own, and then a
pointer file that names it: until the pointer is replaced, in one step, readers
see the tables of the batch before, all of them. `save_all` writes plain folders.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import FOOTER_READER
from . import batches, folders
from .tables import ALL_TABLES

# Names the batches of a folder, the current one last.
POINTER = "_batches"
# What a loaded row had that is no value of its column; readers of tables do not see it.
REJECTED = "_rejected"


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def save_table(name: str, df: DataFrame, folder: str) -> None:
    """Write a table as Parquet, replacing an earlier copy.

    Orders are sorted by purchase time inside each file, which needs no
    shuffle and lets date ranges skip row groups.
    """
    if name == "orders":
        df = df.sortWithinPartitions("order_purchase_timestamp")
    df.write.mode("overwrite").parquet(table_path(folder, name))


def save_all(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write each table as Parquet into the folder, one after the other."""
    for name, df in tables.items():
        save_table(name, df, folder)


def new_batch(folder: str) -> str:
    """A folder for a batch, not yet made and not seen by readers before `commit`."""
    return f"{folder.rstrip('/')}/batch-{batches.now()}"


def commit(spark: SparkSession, batch: str, keep: int = 2) -> None:
    """Make a written batch the current one of its folder and delete all but the last ``keep``.

    Only batches that the pointer names are deleted. One whose writer failed is
    named by nobody and stays until it is removed by `discard`.
    """
    folder, name = batch.rsplit("/", 1)
    known = folders.read_lines(spark, f"{folder}/{POINTER}")
    kept = [*known[max(0, len(known) + 1 - keep) :], name]
    folders.replace_file(spark, f"{folder}/{POINTER}", kept)
    for old in set(known) - set(kept):
        folders.delete(spark, f"{folder}/{old}")


def discard(spark: SparkSession, batch: str) -> None:
    """Delete a batch that is not committed, and folders above it that it leaves empty."""
    folders.delete(spark, batch)
    parent = batch.rsplit("/", 1)[0]
    folders.delete_if_empty(spark, parent)
    folders.delete_if_empty(spark, parent.rsplit("/", 1)[0])


def commit_all(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, keep: int = 2) -> None:
    """Write the tables as a new batch of the folder; readers see all of it or nothing."""
    batch = new_batch(folder)
    try:
        save_all(tables, batch)
    except BaseException:
        discard(spark, batch)
        raise
    commit(spark, batch, keep)


def current_folder(spark: SparkSession, folder: str) -> str:
    """The folder of the current batch, or the folder itself if it was written without batches."""
    known = folders.read_lines(spark, f"{folder.rstrip('/')}/{POINTER}")
    return f"{folder.rstrip('/')}/{known[-1]}" if known else folder


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current batch; the pointer is read once, so all are of the same one."""
    current = current_folder(spark, folder)
    return {name: spark.read.parquet(table_path(current, name)).drop(REJECTED) for name in ALL_TABLES}


def footer_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current batch, read so that their row counts come from the files' footers.

    An aggregate without filters and groups that only counts rows then reads no
    data pages. These tables have no other use: the reader behind them knows
    neither buckets nor the pruning of partitions by a join.
    """
    with _settings(spark, FOOTER_READER):
        return load_all(spark, folder)


@contextmanager
def _settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
