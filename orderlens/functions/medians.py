"""Exact interpolated medians that never hold a group's values in one place.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer; a whole-table median of microsecond durations would put
the table into one task. Here the middle ranks are located by counting rows
per coarse bucket, then only the bucket that contains them is looked at again
in finer buckets, down to single values. Each pass is a narrow scan with a
map-side partial count; what is ranked afterwards is one row per bucket, whose
number is bounded by the bucket widths and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Most groups whose located buckets may be broadcast: two short rows per group.
_BROADCAST_GROUPS = 10_000


def middle_values(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    widths: Sequence[int] = (1_000_000, 1),
    groups_at_most: int | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Lower and upper middle value of an integer column, NULLs ignored.

    Returns ``keys + (lower, upper)`` and the totals, the exact median being the
    mean of the two, which are equal for an odd number of values. Without keys
    there is always one row, holding NULLs for an empty input. ``widths`` descend
    to 1. ``totals`` are sums or counts over all rows of a group, NULL values
    included; the first pass takes them along.

    With a known small number of groups the located buckets are broadcast and
    only their rows are counted again. Otherwise rows are counted per value
    first and the counts joined to the located buckets, so a group with very
    many equal values is one row per task. Buckets of the widths in between are
    made of these counts, without another scan.
    """
    if widths[-1] != 1:
        raise ValueError("the last bucket width must be 1")
    keys, totals = list(keys), dict(totals or {})
    groups = groups_at_most if keys else 1
    few = groups is not None and groups <= _BROADCAST_GROUPS
    rows = df.withColumn("value", F.col(value).cast("bigint"))
    counted = rows.groupBy(*keys, _bucket(widths[0], "bucket")).agg(
        F.count("value").alias("n"), *[total.alias(name) for name, total in totals.items()]
    )
    carried = [*keys, "side", "total", *totals]
    located = _locate_ranks(counted, keys, list(totals))
    narrowed = located
    if len(widths) > 1:
        sized = rows.select(*keys, _bucket(widths[0], "outer"), F.col("value").alias("bucket"))
        if few:
            exact = (
                _meet(sized, located, [*keys, "outer"], few)
                .groupBy(*carried, "rank", "bucket")
                .agg(F.count("*").alias("n"))
            )
        else:
            exact = _meet(
                sized.groupBy(*keys, "outer", "bucket").agg(F.count("*").alias("n")),
                located,
                [*keys, "outer"],
                few,
            )
        for width in widths[1:-1]:
            exact = exact.withColumn("outer", _bucket(width, "outer", "bucket"))
            coarse = exact.groupBy(*carried, "rank", F.col("outer").alias("bucket")).agg(
                F.sum("n").alias("n")
            )
            found = _narrow(coarse, carried).select(*keys, "side", "outer", "rank")
            exact = _meet(exact.drop("rank"), found, [*keys, "side", "outer"], few)
        narrowed = _narrow(exact, carried)
    return narrowed.groupBy(*keys).agg(
        F.min("outer").alias("lower"),
        F.max("outer").alias("upper"),
        *[F.max(name).alias(name) for name in totals],
    )


def _meet(rows: DataFrame, located: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """Inner join in which NULLs are equal, so that groups without any value stay."""
    renamed = located.withColumnsRenamed({c: f"at_{c}" for c in on})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in on))
    joined = rows.join(F.broadcast(renamed) if few else renamed, same)
    return joined.drop(*[f"at_{c}" for c in on])


def _bucket(width: int, name: str, value: str = "value") -> Column:
    """Floor of ``value / width`` on integers, also for negative values."""
    if width == 1:
        return F.col(value).alias(name)
    return F.expr(f"({value} - pmod({value}, {width}L)) div {width}L").alias(name)


def _running_count(groups: Sequence[str]) -> Column:
    group = Window.partitionBy(*(groups or [F.lit(0)]))
    return F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))


def _locate_ranks(counted: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """The buckets holding the two middle ranks, with each rank counted from the bucket's start.

    A group without values has the bucket of its NULLs instead, with rank 0.
    """
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    ranked = counted.select(
        *keys,
        "bucket",
        "n",
        F.sum("n").over(group).alias("total"),
        *[F.sum(name).over(group).alias(name) for name in totals],
        _running_count(keys).alias("through"),
    )
    sides = F.expr(
        "inline(array(named_struct('side', 'lower', 'rank', (total + 1) div 2),"
        " named_struct('side', 'upper', 'rank', IF(total = 0, 0, total div 2 + 1))))"
    )
    return _within(ranked.select("*", sides), [*keys, "side", "total", *totals])


def _narrow(counted: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The finer buckets holding the ranks that were counted from the coarser bucket's start."""
    return _within(counted.withColumn("through", _running_count([*carried, "rank"])), carried)


def _within(ranked: DataFrame, carried: Sequence[str]) -> DataFrame:
    return ranked.where("rank > through - n AND rank <= through OR total = 0 AND bucket IS NULL").selectExpr(
        *carried, "rank - (through - n) AS rank", "bucket AS outer"
    )
