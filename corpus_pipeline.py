"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows the stage before has kept: documents of low quality
go, then toxic ones, then near duplicates, then byte strings that stand earlier
in the corpus; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import packing, quality_classifier, simhash, suffix_dedup, toxicity
from orderlens.llm.workspace import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the quality classifier keeps; it learns from the labels of documents given."""
    return quality_classifier.of_good_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted to be toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return simhash.without_near_duplicates(docs)


def byte_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the strings of 100 bytes that start earlier; ``n_chars`` follows the text.

    A text that is gone altogether leaves an empty one, a null text stays null.
    """
    found = suffix_dedup.remove_repeated_bytes(docs, as_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    cut = found.select("row.*", text.alias("__text")).withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", byte_dedup),
    ("best_fit_packing", packed),
]

# Trained classifiers, components of fingerprints and the packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; each stage's rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
