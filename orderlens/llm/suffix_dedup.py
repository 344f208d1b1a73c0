"""Removal of byte strings that stand earlier in the corpus, by distributed prefix doubling.

Spark deals the passages that share an anchor (see `earlier_copies`) over
buckets, ordered by anchor and place. In a bucket every position gets a rank, equal for equal
first bytes. Sorting the pairs of ranks at growing offsets ranks twice as many
bytes; positions whose rank is unique are out, the others are ranked again until
none is left or the window is reached. Windows that still share a rank are equal,
and all but the first of them have an earlier copy.

A row a position in Spark's own sort would be as many rows as the corpus has
bytes, and again at each offset; so positions become rows (`by window` in
`earlier_copies`) only for anchors that are too frequent for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm import anchors
from orderlens.llm.earlier_copies import HOT_CONTENTS, byte_symbols, earlier_copies, with_spans
from orderlens.llm.workspace import column_of, slices

WINDOW = 100
GRAM = 32


def _ranked(keys: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Ranks from 1 of the places' keys, 0 for unique ones and for all other places."""
    ranks = np.zeros(size, np.int64)
    if len(places):
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, np.diff(keys[order]) != 0]
        group = np.cumsum(new)
        tied = np.bincount(group)[group] > 1
        ranks[places[order[tied]]] = group[tied]
    return ranks


def by_doubling(anchor: np.ndarray, passages: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each passage a mask of its windows that an earlier passage holds."""
    if not passages:
        return []
    sizes = np.array([len(p) for p in passages])
    symbols = np.concatenate(passages)
    total = len(symbols)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)
    width = max(1, window // 4)
    places = np.flatnonzero(left >= width)
    first = anchors.mixed(anchors.gram_hashes(anchors.mixed(symbols.astype(np.uint64) + np.uint64(1)), width))
    ranks = _ranked(first[places].view(np.int64), places, total)
    while width < window:
        offset = min(width, window - width)
        width += offset
        places = np.flatnonzero((ranks > 0) & (left >= width))
        places = places[ranks[places + offset] > 0]
        ranks = _ranked(ranks[places] * (total + 1) + ranks[places + offset], places, total)
    places = np.flatnonzero(ranks)
    marks = np.zeros(total, bool)
    marks[places] = True
    marks[places[np.unique(ranks[places], return_index=True)[1]]] = False
    cuts = np.cumsum(sizes)
    return [marks[end - size : end - window + 1] for end, size in zip(cuts, sizes)]


def remove_repeated_bytes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot_contents: int = HOT_CONTENTS,
    as_text: bool = False,
) -> DataFrame:
    """``row`` (all columns of docs), ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that stay.

    A byte goes if a string of ``window`` bytes around it also starts earlier: in a
    document with a smaller key, or before it in the same document, judged on the
    texts as given, as UTF-8. ``n_spans`` counts the maximal runs of removed bytes.
    ``as_text`` gives what stays as text, less the characters that lost some of
    their bytes.
    Keys are integers; rows with the same key count as one document. A null or
    empty text has no bytes; a row with a null key keeps all of them and removes
    none elsewhere. An empty table gives no rows.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    spans = earlier_copies(texts, byte_symbols, window, gram, by_doubling, hot_contents)
    rows = with_spans(docs, key, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, every in slices(batches, column_of("row", text)):
            found: list[tuple] = []
            lists = zip(part.column("starts").to_pylist(), part.column("lengths").to_pylist())
            for own, (starts, lengths) in zip(every, lists):
                kept, at = [], 0
                for start, length in zip(starts or [], lengths or []):
                    kept.append(own[at:start])
                    at = start + length
                kept.append(own[at:])
                rest = b"".join(kept)
                found.append((len(own), len(own) - len(rest), len(starts or []), rest))
            n_bytes, n_removed, n_spans, rest = zip(*found)
            if as_text:
                rest = pa.array([r.decode(errors="ignore") for r in rest], pa.string())
            else:
                rest = pa.array(rest, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *map(pa.array, (n_bytes, n_removed, n_spans)), rest],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    added = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    kind = T.StringType() if as_text else T.BinaryType()
    schema = T.StructType([rows.schema["row"], *added, T.StructField("kept", kind)])
    return rows.mapInArrow(cut, schema)
