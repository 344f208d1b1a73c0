"""Shared working tables and text batches for the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import use_checkpoint_dir

# Text bytes that a Python step looks at in one go.
SLICE_BYTES = 4 << 20
# Rows of a few numbers that may be broadcast, some tens of MB.
BROADCAST_ROWS = 1_500_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back, which cuts lineage.

    A lost executor then costs a re-read, not a recomputation, and steps that
    use the rows twice see the same rows in the same places.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        use_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def small(rows: DataFrame, count: int) -> DataFrame:
    """The rows, to be broadcast if their count, taken before, allows it."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns as one column ``row``, so that added columns cannot clash with them."""
    return docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))


def column_of(name: str, field: str | None = None) -> Callable[[pa.RecordBatch], pa.Array]:
    """A column of a batch, or a field of a struct column."""
    if field is None:
        return lambda batch: batch.column(name)
    return lambda batch: batch.column(name).field(field)


def parts_of(
    batches: Iterator[pa.RecordBatch],
    limit: int = SLICE_BYTES,
    text_of: Callable[[pa.RecordBatch], pa.Array] = column_of("text"),
) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(text_of(batch)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < len(lengths):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def slices(
    batches: Iterator[pa.RecordBatch],
    text_of: Callable[[pa.RecordBatch], pa.Array] = column_of("text"),
    limit: int = SLICE_BYTES,
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The runs of `parts_of` and their texts (null: empty) as UTF-8."""
    for part in parts_of(batches, limit, text_of):
        texts = text_of(part).cast(pa.binary()).to_pylist()
        yield part, [t or b"" for t in texts]
