"""URL filters that change over time.

List entries are dated: an entry is added to or removed from a list on a day.
The changes of an entry become validity intervals, and every capture is judged
by the entries valid on the day it was fetched.

An entry is a host (which covers its subdomains), a host with a path (which
covers what lies below) or a whole address. All three are text keys, and the
address of a capture is looked up under each key that would cover it. Only
distinct pairs of key and day are looked up, so a host with a third of all
captures is at most one row a day; such pairs and the beginnings of intervals
meet in one window per key, where each pair takes the last interval before it.
The intervals of a key are as few as its days. All steps are DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null if there is none."""
    authority = F.lower(F.regexp_extract(url, ADDRESS, 1))
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*)?$", "")
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path's non-empty segments joined by slashes."""
    segments = F.filter(F.split(F.regexp_extract(url, ADDRESS, 2), "/"), lambda s: s != "")
    return F.array_join(segments, "/")


def covering_keys(host: Column, path: Column) -> Column:
    """The keys of all entries that would cover an address: hosts, paths, the address itself.

    Hosts of at least two labels count (a whole top-level domain is no entry).
    """
    labels = F.split(host, r"\.")
    upward = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        lambda name: (name == host) | F.contains(name, F.lit(".")),
    )
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    depths = F.sequence(F.lit(0), F.size(segments))
    below = F.transform(
        F.filter(depths, lambda n: n > 0),
        lambda n: F.concat(F.lit("path "), host, F.lit("/"), F.array_join(F.slice(segments, 1, n), "/")),
    )
    address = F.array(F.concat(F.lit("address "), host, F.lit("/"), path))
    found = F.concat(F.transform(upward, lambda name: F.concat(F.lit("host "), name)), below, address)
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(found)


def validity_intervals(changes: DataFrame) -> DataFrame:
    """``list, key, valid_from, valid_to`` (exclusive, null if open) from dated changes.

    ``changes`` holds ``list, key, action, day``. Of several changes of an entry on
    one day an addition wins; adding a listed entry or removing an unlisted one
    changes nothing. Rows with a null key, list, day or unknown action are ignored.
    """
    known = changes.where(
        F.col("key").isNotNull() & F.col("list").isNotNull() & F.col("day").isNotNull()
        & F.col("action").isin(ADD, REMOVE)
    )
    daily = known.groupBy("list", "key", "day").agg(F.max(F.col("action") == ADD).alias("listed"))
    order = Window.partitionBy("list", "key").orderBy("day")
    before = F.coalesce(F.lag("listed").over(order), F.lit(False))
    turns = daily.withColumn("before", before).where("listed <> before")
    return (
        turns.withColumn("valid_to", F.lead("day").over(order))
        .where("listed")
        .select("list", "key", F.col("day").alias("valid_from"), "valid_to")
    )


def _active(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """``key, day, list`` of each distinct probe and each list that has its key on that day."""
    lists = intervals.select("list", "key").distinct()
    asked = probes.select("key", "day").distinct().join(lists, "key")
    # on the same day an interval begins before it is asked for
    both = asked.select("list", "key", "day", F.lit(1).alias("asked"), F.lit(None).cast("struct<to:date>").alias("last"))
    both = both.unionByName(
        intervals.select(
            "list", "key", F.col("valid_from").alias("day"), F.lit(0).alias("asked"),
            F.struct(F.col("valid_to").alias("to")).alias("last"),
        )
    )
    order = Window.partitionBy("list", "key").orderBy("day", "asked")
    found = both.withColumn("last", F.last("last", ignorenulls=True).over(order)).where("asked = 1")
    valid = F.col("last").isNotNull() & (F.col("last.to").isNull() | (F.col("day") < F.col("last.to")))
    return found.where(valid).select("key", "day", "list")


def filter_urls(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """All rows and columns of ``captures`` as ``row``, with ``host, n_entries, lists, kept``.

    ``fetched`` is a date or time, ``changes`` as for `validity_intervals`.
    ``n_entries`` counts the valid entries that cover the address, ``lists`` names
    their lists in order, and ``kept`` says that there are none. An address that is
    null, has no host or no fetch time is covered by nothing and kept, its host
    null where there is none. Repeated rows are judged alike; an empty table gives
    no rows, and without changes all rows are kept.
    """
    rows = captures.select(
        F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        F.col(fetched).cast("date").alias("day"),
    )
    asked = rows.where(F.col("host").isNotNull() & F.col("day").isNotNull())
    asked = asked.select("host", "path", "day").distinct()
    probes = asked.withColumn("key", F.explode(covering_keys(F.col("host"), F.col("path"))))
    intervals = validity_intervals(changes)
    covered = (
        probes.join(_active(probes, intervals), ["key", "day"])
        .groupBy("host", "path", "day")
        .agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_set("list")).alias("lists"))
    )
    entries = F.coalesce("n_entries", F.lit(0).cast("bigint"))
    return rows.join(covered, ["host", "path", "day"], "left").select(
        "row", "host", entries.alias("n_entries"),
        F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), (entries == 0).alias("kept"),
    )
