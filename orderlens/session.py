"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffles, splits skewed join partitions, turns joins
# with a side that proves small into broadcasts, and hashes instead of sorting
# where every partition of one side proves small. Not recording the Python call
# site of every column halves the time the driver takes to build a plan.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # of effect on tables read with FOOTER_READER only
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
}

# While these are set, Parquet folders are opened by the reader that can answer
# whole counts from the files' footers.
FOOTER_READER = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}

# Shuffled data a task should hold, well inside an executor's memory per core.
PARTITION_BYTES = 128 << 20


def shuffle_settings(shuffled_bytes: int) -> dict[str, str]:
    """Enough shuffle partitions for the given bytes; adaptive execution merges spare ones."""
    return {"spark.sql.shuffle.partitions": str(max(200, -(-shuffled_bytes // PARTITION_BYTES)))}


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files in the folders, in whatever store they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = [hadoop.Path(path) for path in paths]
    return sum(f.getFileSystem(conf).getContentSummary(f).getLength() for f in folders)


def size_shuffles(spark: SparkSession, stored: int) -> None:
    """Set the shuffle partitions for queries over files of ``stored`` bytes.

    Packed columns take several times their size in a shuffle, but no query
    shuffles all columns, so the stored bytes are taken for the shuffled ones.
    """
    for name, value in shuffle_settings(stored).items():
        spark.conf.set(name, value)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("orderlens")
    settings = {
        **SETTINGS,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="orderlens-checkpoint-")
    context.setCheckpointDir(folder)
