"""Near duplicates by SimHash fingerprints and a byte-position inverted index.

Two 64-bit fingerprints that differ in at most d bits share at least 8 - d of
their 8 byte positions. The positions are cut into d + 4 blocks, of which at
least four stay equal, and the index posts every distinct fingerprint under the
bytes of each three blocks. So two fingerprints within d bits meet in at least
four posting lists (three of the four equal blocks): the lists in which a pair
meets are counted, pairs in fewer are dropped, the others are verified by their
bits. A list longer than ``LIST_LIMIT`` is not paired up. Its fingerprints go
another exact way: each is written under itself and its one-bit neighbours, and
two fingerprints are within two bits exactly if they meet under one of these,
where at most 65 distinct ones can meet. A pair within d bits either shares a
long list, and both go that way, or meets in short lists only, so that its count
is whole. Equal fingerprints are one node, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.components import connected_components
from orderlens.llm.workspace import slices, small, whole_rows, written

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
LIST_LIMIT = 32
BYTES = 8
# Blocks under whose joint bytes a fingerprint is posted, and blocks that stay equal.
JOINT, EQUAL_BLOCKS = 3, 4
LEAST_SHARED = comb(EQUAL_BLOCKS, JOINT)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """``key, fingerprint`` (bigint, the 64 bits) of each row.

    A-Z are lower-cased; words are runs of other than ASCII white space. Shingles
    count as often as they occur. A text with fewer words is one shingle; one
    without words (also null or empty) has fingerprint zero.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = np.fromiter((_fingerprint(t, words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(found.view(np.int64))], ["key", "fingerprint"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(prints, f"key {kind}, fingerprint bigint").withColumnRenamed("key", key)


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    tails = (islice(words, i, None) for i in range(min(size, len(words))))
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*tails)), repeat(SEED))
    count = max(1, len(words) - size + 1)
    values = np.fromiter(hashes, "<u8", count).view(np.uint8).reshape(count, BYTES)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, 1 << 16):
        bits = np.unpackbits(values[start : start + (1 << 16)], axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs ``a, b`` of nodes that connect all fingerprints within ``max_bits`` (1 or 2).

    ``nodes`` holds ``node, fingerprint``, each fingerprint once. Pairs within the
    limit share a component; inside long posting lists not each is listed itself.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    posts = postings(nodes, max_bits)
    pairs = shared_lists(posts.where(F.col("size") <= list_limit)).where(F.col("shared") >= LEAST_SHARED)
    pairs = pairs.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits).select("a", "b")
    long = posts.where(F.col("size") > list_limit).select("node", "fingerprint").distinct()
    return pairs.unionByName(_meet_at_neighbours(long, max_bits)).distinct()


def postings(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``list, value, node, fingerprint, size`` of every posting list that holds more than one node."""
    lists = F.array(*_joint_bytes(F.col("fingerprint"), max_bits + EQUAL_BLOCKS))
    posts = nodes.select("node", "fingerprint", F.posexplode(lists).alias("list", "value"))
    sizes = posts.groupBy("list", "value").agg(F.count("*").alias("size")).where("size > 1")
    return written(posts.join(sizes, ["list", "value"]), "postings")


def shared_lists(posts: DataFrame) -> DataFrame:
    """``a, b, f, g, shared``: pairs of nodes, their fingerprints and in how many lists they meet."""
    one = posts.select("list", "value", F.col("node").alias("a"), F.col("fingerprint").alias("f"))
    other = posts.select("list", "value", F.col("node").alias("b"), F.col("fingerprint").alias("g"))
    met = one.join(other, ["list", "value"]).where("a < b")
    return met.groupBy("a", "b", "f", "g").agg(F.count("*").alias("shared"))


def _joint_bytes(fingerprint: Column, blocks: int) -> list[Column]:
    """The bytes of each three blocks of byte positions, in place in a bigint."""
    cuts = np.linspace(0, BYTES, blocks + 1).round().astype(int)
    masks = []
    for joint in combinations(range(blocks), JOINT):
        mask = 0
        for position in (p for block in joint for p in range(cuts[block], cuts[block + 1])):
            mask |= 255 << (8 * position)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return [fingerprint.bitwiseAND(F.lit(mask).cast("bigint")) for mask in masks]


def _meet_at_neighbours(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Chains ``a, b`` through each value that is within one bit of several nodes."""
    flips = [F.lit(0).cast("bigint")] + [F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)]
    near = nodes.select(
        "node", "fingerprint", F.explode(F.transform(F.array(*flips), lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("value")
    )
    if max_bits == 1:
        near = near.where("value >= fingerprint")
        at = nodes.select(F.col("node").alias("b"), F.col("fingerprint").alias("value"))
        return near.join(at, "value").where("node <> b").select(F.col("node").alias("a"), "b")
    groups = near.groupBy("value").agg(F.collect_list("node").alias("found")).where("size(found) > 1")
    return groups.select(F.array_min("found").alias("a"), F.explode("found").alias("b")).where("a <> b")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    list_limit: int = LIST_LIMIT,
) -> DataFrame:
    """``key, fingerprint`` (16 hex digits), ``component_id`` of each row, keys being distinct.

    The component is the smallest key reachable over links, the row's own
    included. Rows with a null key take no part and are left out. Empty tables
    give empty results; other columns are ignored.
    """
    rows = docs.where(F.col(key).isNotNull())
    prints = written(fingerprints(rows, key, text, words), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min(key).alias("node"))
    nodes = written(nodes, "nodes")
    found = connected_components(links(nodes, max_bits, list_limit), "a", "b")
    of_print = nodes.join(found, "node", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(of_print, "fingerprint").select(
        key, hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with the smallest key of the group, all columns kept.

    Rows are judged, not keys: rows with the same key and different texts may
    belong to different groups, and of several rows of a group that share its
    smallest key one stays. A row with a null key has no duplicates. An empty
    table gives an empty result.
    """
    keys = docs.where(F.col(key).isNotNull()).groupBy(key).count()
    if not keys.where("count > 1").isEmpty():
        return _one_row_a_group(docs, key, text)
    found = near_duplicates(docs, key, text)
    gone = written(found.where(F.col(key) != F.col("component_id")).select(key), "near-duplicates")
    return docs.join(small(gone, gone.count()), key, "left_anti")


def _one_row_a_group(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same for repeated keys: rows are numbered in a written copy, and the number decides."""
    numbered = written(whole_rows(docs).withColumn("number", F.monotonically_increasing_id()), "numbered")
    named = numbered.where(F.col(f"row.{key}").isNotNull())
    texts = named.select(F.col("number"), F.col(f"row.{text}").alias("text"))
    prints = written(fingerprints(texts, "number", "text"), "fingerprints")
    prints = prints.join(named.select("number", F.col(f"row.{key}").alias("key")), "number")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("number").alias("node")), "nodes")
    found = connected_components(links(nodes, MAX_BITS, LIST_LIMIT), "a", "b")
    group = F.coalesce("component", "node").alias("group")
    rows = prints.join(nodes.join(found, "node", "left").select("fingerprint", group), "fingerprint")
    rows = written(rows.select("number", "key", "group"), "groups")
    first = rows.groupBy("group").agg(F.min(F.struct("key", "number")).alias("first"))
    gone = written(rows.join(first.select("first.number"), "number", "left_anti").select("number"), "near-duplicates")
    kept = numbered.join(small(gone, gone.count()), "number", "left_anti")
    return kept.select("row.*")
