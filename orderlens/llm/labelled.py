"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Remainder HELD_OUT of the CRC-32 of the key's text modulo FOLDS is never learned from.
FOLDS, HELD_OUT = 5, 0


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """``key, text, label, fold`` of about ``rows`` labelled documents at most, none held out.

    They are chosen by the hash of their keys. Null keys and labels are left out;
    of several labels the largest counts.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isNotNull())
    known = known.withColumn("fold", fold(F.col("key"))).where(F.col("fold") != HELD_OUT)
    known = known.groupBy("key", "fold").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    buckets = 1 << 20
    known = known.where(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(buckets)) < int(share * buckets))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # broadcast: about `rows` rows of three numbers
    return texts.join(F.broadcast(known), "key").select("key", "text", "label", "fold")
