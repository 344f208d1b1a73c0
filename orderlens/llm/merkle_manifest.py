"""A Merkle manifest of a dataset: an append log of hash trees, proofs and their check.

The leaves of a tree, in order, are dealt to builders in aligned blocks of
``fanout ** depth``. A builder hashes its block alone and appends the nodes in
the order they are completed, which is postorder: each node follows its last
child. A node's place in the log then follows from the sizes of the subtrees
before it (`place`), so the siblings of a path are addressed without a search.
The last nodes of the blocks are the leaves of the next stratum, until every
tree has one block; the roots of all trees are the leaves of one more tree.

Ranks come from a range shuffle and one count a partition, so a tree that holds
a third of all leaves is spread like any other, and no task sees more than one
block of ``fanout ** depth`` leaves at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm.workspace import written

FANOUT = 16
# Levels a builder hashes: blocks of 256 leaves.
DEPTH = 2
# Hexadecimal digits of a digest.
DIGITS = 64


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str], replaced: Mapping[str, Column] | None = None) -> Column:
    """The digest of a row's fields, one after the other. ``replaced``: other values of some."""
    values = {c: F.col(f"`{c}`") for c in columns} | dict(replaced or {})
    return F.sha2(F.concat(*[field(values[c]) for c in columns]), 256)


# -- places --------------------------------------------------------------------


def height_of(leaves: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // fanout), height + 1
    return height


def place(level: int, index: int, leaves: int, fanout: int = FANOUT) -> int:
    """The place in the log of node ``index`` of ``level``, in a tree over ``leaves`` leaves.

    The node is completed by its last leaf. Before it stand all nodes that earlier
    leaves complete, and those of lower levels that this leaf completes too.
    """
    end = min((index + 1) * fanout**level, leaves)
    before, size = -1, 1
    for _ in range(level + 1):
        before += -(-end // size)
        size *= fanout
    while size // fanout < leaves:
        before += (end - 1) // size
        size *= fanout
    return before


def postorder(leaves: Sequence[str], height: int, fanout: int = FANOUT) -> list[str]:
    """All nodes of a subtree of the given height, in the order of completion."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(height + 1)]
    last = len(leaves) - 1
    for number, node in enumerate(leaves):
        log.append(node)
        for level in range(height):
            waiting[level].append(node)
            if len(waiting[level]) < fanout and number < last:
                break
            node = digest("".join(waiting[level]))
            waiting[level] = []
            log.append(node)
    return log


def path(log: str, index: int, leaves: int, height: int, fanout: int = FANOUT) -> list[tuple[int, str]]:
    """For each level the leaf's place in its run and the digests of its siblings, addressed in the log."""
    steps, count = [], leaves
    for level in range(height):
        start = index - index % fanout
        others = [i for i in range(start, min(start + fanout, count)) if i != index]
        at = [DIGITS * place(level, i, leaves, fanout) for i in others]
        steps.append((index - start, "".join([log[a : a + DIGITS] for a in at])))
        index, count = index // fanout, -(-count // fanout)
    return steps


def folded(node: str, steps: Sequence[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for position, siblings in steps:
        cut = DIGITS * position
        node = digest(siblings[:cut] + node + siblings[cut:])
    return node


# -- order and strata ----------------------------------------------------------


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``rank`` (from 0) within their ``tree`` and ``leaves``, the tree's number of rows.

    ``tree`` must not be null. The columns of ``order`` are used up. Their ties are
    broken by digest, then by an order that is the same for all readers of the result.
    """
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", *order, "digest", "row"]
    at = F.monotonically_increasing_id()
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = written(spread.select("*", F.shiftright(at, 33).alias("part"), at.alias("at")), "ordered")
    # one row a tree and partition: as the rows are in order, hardly more than trees and partitions
    counts = spread.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    counts = counts.selectExpr(
        "tree",
        "part",
        "first - (sum(n) OVER (PARTITION BY tree ORDER BY part) - n) AS shift",
        "sum(n) OVER (PARTITION BY tree) AS leaves",
    )
    found = spread.join(counts, ["tree", "part"]).withColumn("rank", F.col("at") - F.col("shift"))
    return found.drop("row", "part", "at", "shift", *order)


@dataclass(frozen=True)
class Log:
    """The append log of a forest.

    ``strata`` hold, from the leaves up, ``tree, block, leaves`` (of the block),
    ``height`` (of its subtree), ``total`` (leaves of the tree in this stratum) and
    ``nodes``, the digests in postorder. ``members`` are the leaves: ``tree``,
    ``block`` and ``at`` (the place within it), ``digest`` and the other columns.
    """

    strata: list[DataFrame]
    members: DataFrame
    fanout: int
    depth: int

    @property
    def width(self) -> int:
        """Leaves of a whole block."""
        return self.fanout**self.depth

    def roots(self) -> DataFrame:
        """``tree, digest``: the last node of each tree."""
        last = F.expr(f"right(nodes, {DIGITS})").alias("digest")
        found = [s.where(F.col("total") <= self.width).select("tree", last) for s in self.strata]
        return reduce(DataFrame.unionByName, found)


def grown(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, depth: int = DEPTH) -> Log:
    """The log of the trees over ``leaves``: ``tree``, ``digest``, the columns of ``order`` and others."""
    width = fanout**depth
    block, at = F.expr(f"rank div {width}"), F.expr(f"CAST(rank % {width} AS INT)")
    members = ranked(leaves, order).withColumns({"block": block, "at": at}).drop("rank")
    members = written(members, "members")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digests = rows.sort_values("at")["digest"].tolist()
        total = int(rows["leaves"].iloc[0])
        height = height_of(total, fanout) if total <= width else depth
        nodes = "".join(postorder(digests, height, fanout))
        return pd.DataFrame([(*key, len(digests), height, total, nodes)])

    schema = "tree string, block bigint, leaves int, height int, total bigint, nodes string"
    strata, level = [], members.select("tree", "block", "at", "digest", "leaves")
    largest = members.agg(F.max("leaves")).first()[0] or 0
    while largest > 0:
        strata.append(written(level.groupBy("tree", "block").applyInPandas(build, schema), "log"))
        level = (
            strata[-1]
            .where(F.col("total") > width)
            .selectExpr(
                "tree",
                f"block div {width} AS block",
                f"CAST(block % {width} AS INT) AS at",
                f"right(nodes, {DIGITS}) AS digest",
                f"(total + {width - 1}) div {width} AS leaves",
            )
        )
        largest = -(-largest // width) if largest > width else 0
    return Log(strata, members.drop("leaves"), fanout, depth)


# -- proofs --------------------------------------------------------------------

PATH = "places array<int>, siblings array<string>"
Steps = list[tuple[int, str]]


def _paths(log: Log, above: DataFrame | None) -> DataFrame:
    """The lowest stratum with the path above each block, found from the highest down.

    ``above``: ``tree`` and the path of the tree's root in a tree of trees.
    """
    kept = ["tree", "block", "leaves", "height", "nodes"]
    nothing = [F.array().cast(kind).alias(n) for n, kind in (f.split(" ") for f in PATH.split(", "))]
    lower = None
    for stratum in reversed(log.strata):
        ends = stratum.where(F.col("total") <= log.width).select(*kept)
        found = ends.select(*kept, *nothing) if above is None else ends.join(above, "tree")
        if lower is not None:
            found = found.unionByName(stratum.select(*kept).join(lower, ["tree", "block"]))
        if stratum is not log.strata[0]:
            lower = written(_below(found, log), "paths")
    return found


def _below(blocks: DataFrame, log: Log) -> DataFrame:
    """``tree, block`` of the stratum below and the path above each of its blocks."""
    width, fanout = log.width, log.fanout

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (b,) = rows.itertuples(index=False)
        found = []
        for at in range(b.leaves):
            steps = path(b.nodes, at, b.leaves, b.height, fanout) + list(zip(b.places, b.siblings))
            found.append((b.tree, b.block * width + at, [p for p, _ in steps], [s for _, s in steps]))
        return pd.DataFrame(found)

    return blocks.groupBy("tree", "block").applyInPandas(split, f"tree string, block bigint, {PATH}")


def _each(
    log: Log, above: DataFrame | None, finish: Callable[[object, Steps], tuple], schema: str
) -> DataFrame:
    """All text columns of the members and what ``finish`` gives for them, block by block."""
    names = [f.name for f in log.members.schema.fields if f.name not in ("tree", "block", "at")]
    fanout = log.fanout

    def check(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        (b,) = blocks.itertuples(index=False)
        upper = list(zip(b.places, b.siblings))
        found = []
        for row in rows.itertuples(index=False):
            steps = path(b.nodes, row.at, b.leaves, b.height, fanout) + upper
            found.append((b.tree, *[getattr(row, n) for n in names], *finish(row, steps)))
        return pd.DataFrame(found)

    kept = ", ".join(f"`{n}` string" for n in ("tree", *names))
    blocks = _paths(log, above).groupBy("tree", "block")
    return log.members.groupBy("tree", "block").cogroup(blocks).applyInPandas(check, f"{kept}, {schema}")


def proofs(log: Log, above: DataFrame | None = None) -> DataFrame:
    """The members, whose columns are text, with ``places`` and ``siblings`` by level.

    ``places`` holds the position of the path in each run, ``siblings`` the run's
    other digests, joined.
    """
    return _each(log, above, lambda row, steps: ([p for p, _ in steps], [s for _, s in steps]), PATH)


def audited(log: Log, above: DataFrame | None = None) -> DataFrame:
    """The members, with a column ``probe``, and the outcome of their proofs.

    ``proof_sha256`` is the digest of all siblings level by level, ``folded_root``
    the root that the probe and the siblings give.
    """

    def finish(row, steps: Steps) -> tuple[str, str]:
        return digest("".join([s for _, s in steps])), folded(row.probe, steps)

    return _each(log, above, finish, "proof_sha256 string, folded_root string")


def manifest(
    rows: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Mapping[str, Column] | None = None,
    tampered_if: Column | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    A leaf is the digest of the row's ``columns``. Per ``group`` (null is one more,
    and the first) the leaves ascend by ``key``, nulls first; equal keys are ordered
    by digest. The trees of the groups, in the order of the groups' UTF-8 bytes, are
    the leaves of one tree. Each row is then checked: its leaf (where ``tampered_if``
    holds, the digest with the columns of ``tampered`` in another form) is folded with
    its siblings and the result compared with the root. Repeated rows are leaves of
    their own with a proof each; texts of any length and null values are hashed
    whole, in the JVM; other columns are ignored; an empty table gives no rows.
    """
    name = F.concat(F.lit("="), F.col(f"`{group}`").cast("string"))
    probe = plain = leaf(columns)
    if tampered:
        probe = F.when(tampered_if, leaf(columns, tampered)).otherwise(plain)
    of = F.col(f"`{key}`")
    log = grown(
        rows.select(
            F.coalesce(name, F.lit("")).alias("tree"),
            of.alias("order"),
            of.cast("string").alias("label"),
            plain.alias("digest"),
            probe.alias("probe"),
        ),
        ["order"],
        fanout,
        depth,
    )
    if not log.strata:
        none = {n: F.lit("") for n in ("subroot", "root", "proof_sha256", "folded_root")}
        return _result(log.members.withColumns(none), key, rows.schema[key].dataType)
    subroots = written(log.roots(), "subroots")
    names = [F.col("tree").alias(n) for n in ("order", "label")]
    top = grown(subroots.select(F.lit("").alias("tree"), *names, "digest"), ["order"], fanout, depth)
    above = proofs(top).select(F.col("label").alias("tree"), "places", "siblings")
    root = top.roots().first()["digest"]
    found = audited(log, above).join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    return _result(found.withColumn("root", F.lit(root)), key, rows.schema[key].dataType)


def _result(found: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    return found.select(
        F.col("label").cast(kind).alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
