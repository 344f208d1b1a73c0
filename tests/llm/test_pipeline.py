import os

import pytest

import corpus_pipeline
from orderlens.llm import packing, quality_classifier, simhash, suffix_dedup, toxicity
from orderlens.llm.workspace import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not present")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    good = written(stages["quality_classifier"](spark, docs, FOLDER), "t")
    expected = quality_classifier.quality_scores(docs, labels).where("kept")
    assert ids(good) == ids(expected) and good.columns == docs.columns
    clean = written(stages["toxicity"](spark, good, FOLDER), "t")
    assert ids(clean) == ids(toxicity.toxicity(good, labels).where("predicted = 0"))
    assert clean.columns == docs.columns
    single = written(stages["simhash_near_dedup"](spark, clean, FOLDER), "t")
    assert ids(single) == ids(simhash.near_duplicates(clean).where("doc_id = component_id"))
    assert single.columns == docs.columns and single.count() < clean.count()
    cut = written(stages["suffix_array_dedup"](spark, single, FOLDER), "t")
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    kept = {r.row.doc_id: bytes(r.kept).decode(errors="ignore") for r in
            suffix_dedup.remove_repeated_bytes(single).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    packed = stages["best_fit_packing"](spark, cut, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(kept)
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed))
    filled = {}
    for r in packed:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= packing.CAPACITY


def test_awkward_documents_pass_through(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "no id", None, None, 5), (5000, None, "en", "src1", 0), (5001, "", "en", "src1", 0),
         (5002, "x" * 3000, None, "src1", 3000), (5003, "twice", "en", "src2", 5), (5003, "twice", "en", "src2", 5)],
        docs.schema)
    every = docs.unionByName(odd).selectExpr("*", "1 AS row", "2 AS score", "3 AS kept", "4 AS key")
    every.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before, current = current, written(stage(spark, current, str(tmp_path)), "t")
        assert current.columns == before.columns or stage is corpus_pipeline.packed
    assert current.count() > 0


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
