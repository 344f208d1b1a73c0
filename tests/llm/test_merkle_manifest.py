import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from orderlens.llm import merkle_manifest as merkle
from orderlens.llm import queries
from tests.llm.helpers import AWKWARD, documents

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    fields = ["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS]
    return digest("".join(fields))


def levels(nodes, fanout):
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return found


def siblings(tree, index, fanout):
    found = []
    for level in tree[:-1]:
        start = index - index % fanout
        found += [n for i, n in enumerate(level[start : start + fanout], start) if i != index]
        index //= fanout
    return found


def expected(rows, fanout):
    """leaf, subroot, root, proof_sha256 of each row, in plain Python."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        found = [((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), r) for r in by_source[name]]
        found.sort(key=lambda pair: pair[0])
        trees.append((found, levels([key[2] for key, _ in found], fanout)))
    top = levels([tree[-1][0] for _, tree in trees], fanout)
    result = []
    for number, (found, tree) in enumerate(trees):
        for index, (key, row) in enumerate(found):
            proof = digest("".join(siblings(tree, index, fanout) + siblings(top, number, fanout)))
            result.append((row["doc_id"], key[2], tree[-1][0], top[-1][0], proof))
    return result


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fanout, depth", [(16, 2), (3, 1)])
def test_against_plain_trees(spark, fanout, depth):
    texts = AWKWARD + [f"Text {i}" for i in range(60)] + [(7, "again"), (7, "again"), (None, "no key"), (None, None)]
    source = F.expr("CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id < 30 THEN 'hot' ELSE concat('ä', doc_id % 4) END")
    docs = documents(spark, texts, ["1 AS tree", "'x' AS digest", "2 AS rank"]).withColumn("source", source)
    found = merkle.manifest(docs, fanout=fanout, depth=depth).collect()
    rows = [r.asDict() for r in docs.collect()]
    assert ordered(tuple(r)[:5] for r in found) == ordered(expected(rows, fanout))
    assert all(r.verified and r.folded_root == r.root for r in found)


@pytest.mark.parametrize("count", [1, 2, 3, 8, 9, 10, 27, 28, 100])
def test_places_are_those_of_the_log(count):
    """The closed form gives the order in which a log writer completes the nodes."""
    tree = levels([str(i) for i in range(count)], 3)
    log = merkle.postorder(tree[0], len(tree) - 1, 3)
    assert len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for index, node in enumerate(nodes):
            assert log[merkle.place(level, index, count, 3)] == node


def test_tampering_shows(spark):
    docs = documents(spark, ["Abc", "abc", None, "Ä", "XYZ"])
    found = merkle.manifest(docs, tampered={"text": F.lower("text")}, tampered_if=F.col("doc_id") < 4)
    assert {r.doc_id: r.verified for r in found.collect()} == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_one_row_no_row_and_large_keys(spark):
    assert merkle.manifest(documents(spark, ["x"]).limit(0)).collect() == []
    docs = documents(spark, [(2**62 + 1, "x"), (None, "y")])
    found = merkle.manifest(docs.withColumn("source", F.lit("s"))).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 2**62 + 1]
    (alone,) = merkle.manifest(docs.limit(1)).collect()
    assert alone.root == alone.subroot == alone.leaf and alone.proof_sha256 == digest("") and alone.verified


def test_proofs_fold_to_the_root(spark):
    leaves = spark.range(40).selectExpr("'t' AS tree", "id AS order", "sha2(CAST(id AS STRING), 256) AS digest")
    log = merkle.grown(leaves, ["order"], fanout=3, depth=2)
    root = log.roots().first()["digest"]
    for row in merkle.proofs(log).collect():
        assert merkle.folded(row.digest, list(zip(row.places, row.siblings))) == root
        assert merkle.folded("0" * 64, list(zip(row.places, row.siblings))) != root


def test_query_against_sql(spark, tmp_path):
    texts = [(i, f"Doc {i}" if i % 7 else None) for i in range(1, 700)]
    source = F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'hot' ELSE concat('s', doc_id % 19) END")
    documents(spark, texts).withColumn("source", source).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_merkle_manifest(spark, str(tmp_path))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = base.sql(queries.ORACLES["op13_merkle_manifest"]).project(", ".join(found.columns)).fetchall()
    assert ordered(map(tuple, found.collect())) == ordered(rows)
    unverified = {r.doc_id for r in found.collect() if not r.verified}
    assert unverified == {i for i, t in texts if t and zlib.crc32(str(i).encode()) % 5 == 0}
