"""Typed CSV scan of the source tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parquet_files import REJECTED
from .tables import ALL_TABLES, Table

# Quoting of the source files (RFC 4180, doubled quotes).
_FORMAT = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_text(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """One source table as text, columns matched by header name.

    Unknown columns are kept and missing ones left for the column check. Only the
    files whose texts can hold line breaks are read unsplit.
    """
    path = f"{folder.rstrip('/')}/{table.file_pattern}"
    try:
        header = spark.read.options(**_FORMAT).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no file for table {table.name}: {path}") from e
    return (
        spark.read.options(**_FORMAT, multiLine=table.quoted_newlines, enforceSchema=False)
        .schema(T.StructType([T.StructField(name, T.StringType()) for name in header]))
        .csv(path)
    )


def _numbers(table: Table, columns: Sequence[str]) -> dict[str, T.DataType]:
    declared = {f.name: f.dataType for f in table.schema.fields}
    return {c: declared[c] for c in columns if isinstance(declared.get(c), T.NumericType)}


def _as_number(name: str, kind: T.DataType) -> Column:
    return F.nullif(F.col(name), F.lit("")).try_cast(kind)


def with_numbers(text: DataFrame, table: Table) -> DataFrame:
    """Numbers in their declared types; timestamps stay text until they are cleaned.

    A malformed number becomes NULL here; `parsed` keeps and counts it.
    """
    numbers = _numbers(table, text.columns)
    return text.withColumns({name: _as_number(name, kind) for name, kind in numbers.items()})


@dataclass(frozen=True)
class Parsed:
    """A table as parsed from its files, with ``REJECTED``, and what is observed while it is written."""

    table: Table
    rows: DataFrame
    seen: Observation | None
    numbers: frozenset[str]

    def malformed(self) -> dict[str, int]:
        """Malformed values by column, where there are any; known once the rows were written."""
        counts = self.seen.get if self.seen else {}
        return {c: n for c, n in counts.items() if c != _ROWS and n}


_ROWS = "__rows"
# File and values of a row that are none of their column's type.
_REJECTED_TYPE = "struct<file:string,found:array<struct<column_name:string,value:string>>>"


def parsed(spark: SparkSession, folder: str, table: Table) -> Parsed:
    """One source table in its declared types, for one pass over the files.

    A malformed number or timestamp becomes NULL, is counted by column while the
    rows are written, and stays with its row and file in the column ``REJECTED``.
    """
    text = read_text(spark, folder, table)
    declared = {f.name: f.dataType for f in table.schema.fields}
    numbers = _numbers(table, text.columns)
    casts = {c: _as_number(c, kind) for c, kind in numbers.items()}
    casts |= {c: F.col(c).try_cast(declared[c]) for c in table.moments if c in text.columns}
    bad = {c: F.nullif(F.col(c), F.lit("")).isNotNull() & cast.isNull() for c, cast in casts.items()}
    if not bad:
        nothing = F.lit(None).cast(_REJECTED_TYPE).alias(REJECTED)
        return Parsed(table, text.select("*", nothing), None, frozenset())
    seen = Observation(f"parsed {table.name}")
    text = text.observe(seen, F.count("*").alias(_ROWS), *[F.count_if(b).alias(c) for c, b in bad.items()])
    values = [F.when(b, F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c, b in bad.items()]
    found = F.filter(F.array(*values), lambda value: value.isNotNull())
    where = F.struct(F.col("_metadata.file_path").alias("file"), found.alias("found"))
    rejected = F.when(reduce(Column.__or__, bad.values()), where).cast(_REJECTED_TYPE).alias(REJECTED)
    columns = [casts[c].alias(c) if c in casts else F.col(c) for c in text.columns]
    return Parsed(table, text.select(*columns, rejected), seen, frozenset(numbers))


def rejected_values(name: str, saved: DataFrame) -> DataFrame:
    """``table_name, column_name, value, file`` of each malformed value in a table that `parsed` gave."""
    rows = saved.where(F.col(REJECTED).isNotNull()).select(REJECTED)
    return rows.select(F.lit(name).alias("table_name"), F.col(f"{REJECTED}.file").alias("file"),
                       F.inline(f"{REJECTED}.found")).select("table_name", "column_name", "value", "file")


def read_table(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """One source table, numbers typed and timestamps as text."""
    return with_numbers(read_text(spark, folder, table), table)


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every source table by name."""
    return {name: read_table(spark, folder, table) for name, table in ALL_TABLES.items()}
