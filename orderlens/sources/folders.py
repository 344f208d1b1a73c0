"""Files and folders of whatever store the paths name, through Spark's own access to it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds, if it is there."""
    at, store = _at(spark, path)
    store.delete(at, True)


def delete_if_empty(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    if store.exists(at) and not store.listStatus(at):
        store.delete(at, False)


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, store = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file, none if it is not there."""
    at, store = _at(spark, path)
    if not store.exists(at):
        return []
    stream = store.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return text.splitlines()


def replace_file(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write a small file beside ``path`` and put it there in one step."""
    jvm = spark.sparkContext._jvm
    at, store = _at(spark, path)
    beside, _ = _at(spark, f"{path}.new")
    stream = store.create(beside, True)
    try:
        stream.write("".join(f"{line}\n" for line in lines).encode())
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    rename[0] = files.Options.Rename.OVERWRITE
    context.rename(store.makeQualified(beside), store.makeQualified(at), rename)
