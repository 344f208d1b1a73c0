"""Passages that an earlier place of the corpus holds too.

A window is so many consecutive symbols (bytes, or words) of one document. A
window has an earlier copy if the same symbols also start earlier: in a document
with a smaller key, or before it in the same document. Found are the spans that
such windows cover.

Equal windows have equal anchors (see `anchors`), so:

1. every document is cut into runs of windows with the same anchor;
2. of the runs with the same anchor and content all but the first have earlier
   copies throughout. Each task leaves out those it sees itself, so a very
   frequent run is one row a slice of texts;
3. the others meet by anchor in one shuffle. Runs whose anchor hash occurs once
   are done, as they share nothing;
4. only where contents with the same anchor differ are single windows compared,
   and only in the first run of each content: by the operator's own method, on
   buckets of anchors. Anchors with more than ``HOT_CONTENTS`` contents go
   another exact way, one row a window grouped by its hash, which no anchor can
   make uneven;
5. spans are united per document and carried to the texts.

The texts themselves are never shuffled while the spans, whose number is counted
first, are small enough to broadcast; otherwise both are joined by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm import anchors
from orderlens.llm.workspace import slices, small, written

BLOCK_SYMBOLS = 1 << 20
BUCKET_CONTENTS = 16_384
HOT_CONTENTS = 4096
# From the anchors and symbols of passages, ordered by anchor and then by place, and the
# window: for each passage a mask of its windows with a copy in an earlier passage.
Resolver = Callable[[np.ndarray, list[np.ndarray], int], list[np.ndarray]]


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and how many each text has."""
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, and how many each text has."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    every = (xxhash.xxh3_64_intdigest(word) for own in words for word in own)
    return np.fromiter(every, np.uint64, int(sizes.sum())), sizes


_ODD = 0x9E3779B97F4A7C15
_SPREAD_BYTES = anchors.mixed(np.arange(1, 257, dtype=np.uint64))


def _spread(symbols: np.ndarray) -> np.ndarray:
    return _SPREAD_BYTES[symbols] if symbols.dtype == np.uint8 else symbols


def _all_runs(symbols_of, window: int, gram: int):
    """Rows of ``key, start, windows, anchor, content`` and ``later`` for each slice of texts.

    Of the runs of a slice with the same anchor and content all but the first are
    known to be later ones, so a frequent run goes on once a slice. These have a
    made-up anchor that spreads them evenly.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            symbols, sizes = symbols_of(texts)
            keys = part.column("key").to_numpy()
            first = np.cumsum(sizes) - sizes
            blocks = []
            for at in range(0, len(symbols), BLOCK_SYMBOLS):
                stop = min(len(symbols), at + BLOCK_SYMBOLS + window - 1)
                place = np.arange(at, stop)
                text = np.searchsorted(first + sizes, place, "right")
                left = (first + sizes)[text] - place
                start, windows, anchor, content = anchors.runs(
                    _spread(symbols[at:stop]), left, window, gram
                )
                text = text[start]
                blocks.append((keys[text], at + start - first[text], windows, anchor, content))
            if not blocks:
                continue
            key, start, windows, anchor, content = (np.concatenate(column) for column in zip(*blocks))
            order = np.lexsort((start, key, content, anchor))
            new = np.ones(len(key), bool)
            for column in (anchor, content):
                new[1:] &= column[order][1:] == column[order][:-1]
            new[1:] = ~new[1:]
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            later = np.zeros(len(key), bool)  # a repeated row is at the same place, not later
            later[order] = (key[order] != key[lead]) | (start[order] != start[lead])
            spread = anchors.mixed(key.astype(np.uint64) * np.uint64(_ODD) + start.astype(np.uint64))
            anchor = np.where(later, spread, anchor)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key),
                    pa.array(start),
                    pa.array(windows.astype(np.int32)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    pa.array(later),
                ],
                ["key", "start", "windows", "anchor", "content", "later"],
            )

    return found


def earlier_copies(
    docs: DataFrame,
    symbols_of: Callable,
    window: int,
    gram: int,
    resolve: Resolver,
    hot_contents: int = HOT_CONTENTS,
) -> DataFrame:
    """``key, start, length`` of the spans of ``docs`` (``key, text``), united and apart.

    Rows with a null key take no part; rows with the same key are one document.
    """
    docs = docs.where("key IS NOT NULL")
    runs = docs.mapInArrow(
        _all_runs(symbols_of, window, gram),
        "key bigint, start bigint, windows int, anchor bigint, content bigint, later boolean",
    )
    # one shuffle by anchor serves all windows; known later runs are groups of their own
    by_anchor = Window.partitionBy("anchor", "later")
    by_content = Window.partitionBy("anchor", "later", "content").orderBy("key", "start")
    runs = (
        runs.repartition("anchor")
        .withColumn("place", F.rank().over(by_content))
        .withColumn("shared", F.count("*").over(by_anchor) > 1)
        .withColumn("differ", F.min("content").over(by_anchor) != F.max("content").over(by_anchor))
        .where("later OR shared AND (place > 1 OR differ)")
        .select("key", "start", "windows", "anchor", (F.col("later") | (F.col("place") > 1)).alias("later"))
    )
    runs = written(runs, "runs")
    length = (F.col("windows") + window - 1).cast("bigint")
    spans = runs.where("later").select("key", "start", length.alias("length"))
    unsure = runs.where("NOT later").select("anchor", "key", "start", "windows")
    sizes = unsure.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > hot_contents).select("anchor", F.lit(True).alias("hot"))
    hot = written(hot, "hot")
    unsure = unsure.join(small(hot, hot.count()), "anchor", "left")
    passages = written(_passages(docs, unsure, symbols_of, window), "passages")
    kind = symbols_of([])[0].dtype.type
    spans = spans.unionByName(_by_bucket(passages.where("hot IS NULL"), kind, window, resolve))
    if hot.count():
        spans = spans.unionByName(_by_window(passages.where("hot"), kind, window))
    return written(_united(spans), "spans")


def _passages(docs: DataFrame, wanted: DataFrame, symbols_of: Callable, window: int) -> DataFrame:
    """``anchor, key, start, symbols, hot`` with the symbols (bytes, or words as 8 bytes) of each run."""
    grouped = wanted.groupBy("key").agg(
        F.collect_list(F.struct("start", F.col("windows").cast("bigint").alias("windows"), "anchor", "hot")).alias("runs")
    )
    grouped = written(grouped.select("key", "runs.start", "runs.windows", "runs.anchor", "runs.hot"), "wanted")
    total = grouped.agg(F.coalesce(F.sum(F.size("start")), F.lit(0))).first()[0]
    rows = docs.join(small(grouped, total), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            columns = {n: [] for n in ("anchor", "key", "start", "symbols", "hot")}
            lists = zip(*(part.column(n).to_pylist() for n in ("key", "start", "windows", "anchor", "hot")))
            for text, (key, starts, windows, anchor, hot) in zip(texts, lists):
                symbols, _ = symbols_of([text])
                columns["symbols"] += [
                    symbols[s : s + n + window - 1].tobytes() for s, n in zip(starts, windows)
                ]
                columns["anchor"] += anchor
                columns["hot"] += hot
                columns["start"] += starts
                columns["key"] += [key] * len(starts)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            arrays = [pa.array(v, k) for v, k in zip(columns.values(), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, list(columns))

    return rows.mapInArrow(cut, "anchor bigint, key bigint, start bigint, symbols binary, hot boolean")


def _spans_of(masks: list[np.ndarray], keys, starts, window: int) -> pd.DataFrame:
    """The stretches of marked windows as spans."""
    rows = []
    for mask, key, start in zip(masks, keys, starts):
        if mask.any():
            change = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
            rows += [(key, start + a, b - a + window - 1) for a, b in change.reshape(-1, 2).tolist()]
    return pd.DataFrame(rows, columns=["key", "start", "length"]).astype(np.int64)


def _by_bucket(passages: DataFrame, kind: type, window: int, resolve: Resolver) -> DataFrame:
    def resolved(rows: pd.DataFrame) -> pd.DataFrame:
        # a document whose row is repeated is one
        rows = rows.drop_duplicates(["anchor", "key", "start"]).sort_values(["anchor", "key", "start"])
        symbols = [np.frombuffer(s, kind) for s in rows["symbols"]]
        masks = resolve(rows["anchor"].to_numpy(), symbols, window)
        return _spans_of(masks, rows["key"].tolist(), rows["start"].tolist(), window)

    buckets = -(-passages.count() // BUCKET_CONTENTS) or 1
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets))
    rows = passages.select("anchor", "key", "start", "symbols", bucket.alias("bucket"))
    return rows.groupBy("bucket").applyInPandas(resolved, "key bigint, start bigint, length bigint")


def _by_window(passages: DataFrame, kind: type, window: int) -> DataFrame:
    """One row a window, grouped by 128 bits of hash; for anchors with very many contents."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["key", "start", "symbols"]).to_pylist():
                symbols = _spread(np.frombuffer(row["symbols"], kind))
                one = anchors.gram_hashes(symbols, window).view(np.int64)
                two = anchors.gram_hashes(anchors.mixed(symbols), window).view(np.int64)
                place = row["start"] + np.arange(len(one))
                columns = [np.full(len(one), row["key"]), place, one, two]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["key", "start", "one", "two"]
                )

    rows = passages.mapInArrow(hashed, "key bigint, start bigint, one bigint, two bigint")
    rows = written(rows, "windows")
    first = rows.groupBy("one", "two").agg(F.min(F.struct("key", "start")).alias("at"))
    later = rows.join(first, ["one", "two"]).where(F.struct("key", "start") != F.col("at"))
    return later.select("key", "start", F.lit(window).cast("bigint").alias("length"))


def _united(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch become one."""
    order = Window.partitionBy("key").orderBy("start", "length")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("start") + F.col("length")
    marked = spans.withColumn("reached", F.max(ends).over(before))
    apart = F.coalesce(F.col("start") > F.col("reached"), F.lit(True)).cast("int")
    numbered = marked.withColumn("island", F.sum(apart).over(order))
    united = numbered.groupBy("key", "island").agg(F.min("start").alias("start"), F.max(ends).alias("end"))
    return united.select("key", "start", (F.col("end") - F.col("start")).alias("length"))


def with_spans(docs: DataFrame, key: str, spans: DataFrame) -> DataFrame:
    """``row`` (all columns of docs), ``starts`` and ``lengths`` (null where there are none)."""
    grouped = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("s"))
    grouped = grouped.select("key", F.col("s.start").alias("starts"), F.col("s.length").alias("lengths"))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(small(grouped, spans.count()), F.col(f"row.{key}") == F.col("key"), "left")
    return rows.select("row", "starts", "lengths")
