"""Connected components of a graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.workspace import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of an edge; component is the smallest node reachable.

    Large-star and small-star rounds: every node hooks its larger, then its
    smaller neighbours to the smallest one, until each component is a star. The
    minima are summed map-side, so a node with very many neighbours is one row
    per task. Edges with a null end or both ends equal are left out.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = written(pairs.distinct(), "edges")
    last, state = None, _state(pairs)
    while state != last:
        pairs = written(_small_star(_large_star(pairs)), "edges")
        last, state = state, _state(pairs)
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return centres.unionByName(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")))


def _state(pairs: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(digest)).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    smallest = F.col("m").alias("v")
    ends = F.array(F.struct("u", smallest), F.struct(F.col("v").alias("u"), smallest))
    hooked = pairs.join(least, "u").select(F.explode(ends).alias("end"))
    return hooked.select("end.u", "end.v").where("u > v").distinct()
