"""Batches of published tables: who owns a database, which batch is current, which may go.

A batch is a database ``NAME__BATCH`` that carries marks: the name it belongs to
and when it was begun and published. Only marked databases are ever dropped, so
one that merely has a similar name is safe.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_CURRENT = "current_batch"
_OWNER, _BEGUN, _PUBLISHED = "orderlens.owner", "orderlens.begun", "orderlens.published"


class BatchExistsError(ValueError):
    """A database with the batch's name is there already."""


@dataclass(frozen=True)
class Batch:
    home: str  # its database
    begun: str
    published: str | None


def now() -> str:
    """The time to the microsecond, in digits that sort by time."""
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")


def properties(spark: SparkSession, database: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED `{database}`").collect()
    text = next((row[1] for row in rows if row[0] == "Properties"), "")
    return dict(re.findall(r"\(([^(),]+),([^()]*)\)", text))


def location(spark: SparkSession, database: str) -> str:
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED `{database}`").collect()
    return next(row[1] for row in rows if row[0] == "Location").rstrip("/")


def begin(spark: SparkSession, database: str, batch: str) -> str:
    """Make the marked database of a new batch; raises if its name is taken."""
    home = f"{database}__{batch}"
    marks = f"'{_OWNER}' = '{database}', '{_BEGUN}' = '{now()}'"
    try:
        spark.sql(f"CREATE DATABASE `{home}` WITH DBPROPERTIES ({marks})")
    except AnalysisException as e:
        if e.getCondition() != "SCHEMA_ALREADY_EXISTS":
            raise
        raise BatchExistsError(f"{home} exists; choose another batch name") from e
    return home


def finish(spark: SparkSession, home: str) -> None:
    """Mark the batch as complete."""
    spark.sql(f"ALTER DATABASE `{home}` SET DBPROPERTIES ('{_PUBLISHED}' = '{now()}')")


def switch(spark: SparkSession, database: str, batch: str) -> None:
    """Make the batch the current one, in one step."""
    spark.sql(f"ALTER DATABASE `{database}` SET DBPROPERTIES ('{_CURRENT}' = '{batch}')")


def current_database(spark: SparkSession, database: str) -> str:
    """The database that holds the current batch, for ``USE`` and for qualified names."""
    batch = properties(spark, database).get(_CURRENT)
    if batch is None:
        raise LookupError(f"{database}: nothing has been published")
    return f"{database}__{batch}"


def own_batches(spark: SparkSession, database: str) -> list[Batch]:
    """The marked batches of the database, in the order they were begun."""
    found = []
    for row in spark.sql(f"SHOW DATABASES LIKE '{database}__*'").collect():
        marks = properties(spark, row[0])
        if marks.get(_OWNER) == database and _BEGUN in marks:
            found.append(Batch(row[0], marks[_BEGUN], marks.get(_PUBLISHED)))
    return sorted(found, key=lambda batch: batch.begun)


def outdated(batches: list[Batch], current: str, keep: int) -> list[Batch]:
    """The batches to drop: all but the current one and the last ``keep`` published ones.

    A batch that was never published has failed or is being written: it goes once
    it was begun before everything that is kept.
    """
    published = sorted((b for b in batches if b.published), key=lambda b: b.published)
    kept = {b.home for b in published[max(0, len(published) - keep) :]} | {current}
    oldest = min((b.begun for b in batches if b.home in kept), default="")
    return [b for b in batches if b.home not in kept and (b.published or b.begun < oldest)]
