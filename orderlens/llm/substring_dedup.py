"""Removal of word sequences that stand earlier in the corpus, by suffix automata.

The reference shards are the passages that share an anchor (see
`earlier_copies`), of bounded number, each content once. A shard's suffix
automaton grows passage by passage in the order of the corpus. Before a passage
is added it streams through the automaton, whose state after each word gives the
matching statistic: the length of the longest sequence ending there that an
earlier passage holds. Words of matches of at least ``WINDOW`` words go.

Sending every shard to every document would take as many passes over the corpus
as there are shards, and their number grows with the corpus. A shard therefore
meets only the passages with its anchor, which are all that can match it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm.earlier_copies import HOT_CONTENTS, earlier_copies, with_spans, word_symbols
from orderlens.llm.workspace import column_of, slices

WINDOW = 20
GRAM = 8


class SuffixAutomaton:
    """The suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            last = self._extended(last, symbol)

    def _extended(self, last: int, symbol) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return self._exact(last, symbol, known)
        state = self._new({}, self.length[last] + 1)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = state
            last = self.link[last]
        self.link[state] = 0 if last < 0 else self._exact(last, symbol, self.next[last][symbol])
        return state

    def _exact(self, before: int, symbol, state: int) -> int:
        """The state whose longest sequence is that of ``before`` and the symbol, split off if need be."""
        if self.length[state] == self.length[before] + 1:
            return state
        clone = self._new(self.next[state].copy(), self.length[before] + 1)
        self.link[clone], self.link[state] = self.link[state], clone
        while before >= 0 and self.next[before].get(symbol) == state:
            self.next[before][symbol] = clone
            before = self.link[before]
        return clone

    def _new(self, following: dict, length: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def matching(self, sequence: list) -> list[int]:
        """For each place, how long the longest sequence ending there is that the automaton holds."""
        following, link, lengths = self.next, self.link, self.length
        state = length = 0
        found = []
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                length = lengths[state]
            if symbol in following[state]:
                state = following[state][symbol]
                length += 1
            else:
                length = 0
            found.append(length)
        return found


def by_automata(anchor: np.ndarray, passages: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each passage a mask of its windows that an earlier passage of the same anchor holds."""
    masks, shard, of = [], SuffixAutomaton(), None
    for own, passage in zip(anchor.tolist(), passages):
        if own != of:
            shard, of = SuffixAutomaton(), own
        words = passage.tolist()
        masks.append(np.array(shard.matching(words)[window - 1 :]) >= window)
        shard.add(words)
    return masks


def remove_repeated_words(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot_contents: int = HOT_CONTENTS,
) -> DataFrame:
    """``row`` (all columns of docs), ``n_words, n_removed`` and ``kept``, the words that stay.

    A word goes if a window of ``window`` words around it also starts earlier: in a
    document with a smaller key, or before it in the same document, judged on the
    texts as given. Words are runs of other than ASCII white space; those that stay
    are joined by one space. Keys are integers; rows with the same key count as one
    document. A null or empty text has no words; a row with a null key keeps all of
    them and removes none elsewhere. An empty table gives no rows.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    spans = earlier_copies(texts, word_symbols, window, gram, by_automata, hot_contents)
    rows = with_spans(docs, key, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, every in slices(batches, column_of("row", text)):
            found: list[tuple] = []
            lists = zip(part.column("starts").to_pylist(), part.column("lengths").to_pylist())
            for own, (starts, lengths) in zip(every, lists):
                words = own.split()
                kept, at = [], 0
                for start, length in zip(starts or [], lengths or []):
                    kept += words[at:start]
                    at = start + length
                kept += words[at:]
                found.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            n_words, n_removed, kept = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(n_words), pa.array(n_removed), pa.array(kept)],
                ["row", "n_words", "n_removed", "kept"],
            )

    added = [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")]
    schema = T.StructType([rows.schema["row"], *added, T.StructField("kept", T.StringType())])
    return rows.mapInArrow(cut, schema)
