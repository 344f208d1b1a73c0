"""Quality rules with suffix-array repetition.

The words of a run of documents form one sequence, whose suffixes end with their
document. Suffixes that share a prefix with another one of the same document are
ordered by prefix doubling: after the pairs of words, only suffixes still tied
are sorted again, by the ranks at twice the offset, until none is tied. The
longest common prefixes of neighbours in that order give the intervals of
maximal repeated substrings: the deepest interval a suffix belongs to is as long
as the larger of its two common prefixes. The spans of those with at least
``MIN_REPEAT`` words are united; a document fails if they cover more than
``MAX_COVERED`` percent of its words or if one is longer than ``MAX_REPEAT``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.workspace import slices

MIN_REPEAT = 8
# Published filters allow 12 % of a text in repeats of eight words. Of 3,243 documents labelled good
# that the base rules keep, 0.9 % have more than 10 % of their words in such repeats and 0.5 % more
# than 15 %; of 291 labelled bad, 2.4 % and 0.7 %. No good one repeats more than 13 words at a stretch.
MAX_COVERED = 12
MAX_REPEAT = 50
MIN_WORDS = 50
MAX_REPEATED_WORDS = 50

SPACE = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
# For each byte: whether it begins a code point of a word, and whether it is a symbol.
_BYTE_WEIGHTS = np.array(
    [[b & 0xC0 != 0x80 and b not in SPACE for b in range(256)], [b in SYMBOLS for b in range(256)]]
).astype(np.int64)

_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    ", ".join(f"{name} bigint" for name in (*_NUMBERS, "n_covered_words", "longest_repeat"))
    + ", base_failed boolean, kept boolean"
)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and for each place in it where its group of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


class Repeats:
    """Repeated word sequences within each of several documents."""

    def __init__(self, documents: list[list[bytes]]):
        self.sizes = np.array([len(words) for words in documents], np.int64)
        self.total = int(self.sizes.sum())
        self.first = np.cumsum(self.sizes) - self.sizes
        document = np.repeat(np.arange(len(documents)), self.sizes)
        self.left = np.repeat(self.first + self.sizes, self.sizes) - np.arange(self.total)
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        every = (word for words in documents for word in words)
        word = np.fromiter(map(numbers.__getitem__, every), np.int64, self.total)
        kinds = len(numbers) + 1
        # ranks[k]: equal exactly for suffixes with the same 2**k words; ordered like them
        self.ranks = [document * kinds + word]
        if self.total:
            following = self._at(word, np.arange(self.total), 1)
            self.ranks.append(self._ranked(np.arange(self.total), self.ranks[0], following, kinds))

    def _at(self, values: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
        """The values ``offset`` words further, zero beyond the document."""
        inside = self.left[places] > offset
        return np.where(inside, values[np.minimum(places + offset, self.total - 1)], 0)

    def _ranked(self, places, one, two, kinds) -> np.ndarray:
        order, group = _dense(one * kinds + two)
        rank = np.empty(self.total, np.int32 if self.total < 1 << 31 else np.int64)
        rank[places[order]] = group + 1
        return rank

    def _joined(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers ordered like pairs of ranks, which are small integers to save memory."""
        return one.astype(np.int64) * (self.total + 2) + two

    def _tied(self, rank: np.ndarray, among: np.ndarray) -> np.ndarray:
        size = np.bincount(rank[among], minlength=self.total + 2)
        return among[size[rank[among]] > 1]

    def triples(self) -> np.ndarray:
        """Per document, the words within a window of three words that occurs twice or more."""
        if not self.total:
            return np.zeros(len(self.sizes), np.int64)
        tied = self._tied(self.ranks[1], np.arange(self.total))
        tied = tied[self.left[tied] >= 3]
        rank = self.ranks[1]
        order, group = _dense(self._joined(rank[tied], rank[tied + 1]))
        repeated = tied[order[np.bincount(group, minlength=len(tied))[group] > 1]]
        return self._summed(self._covered(repeated, np.full(len(repeated), 3)))

    def maximal(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Per document, the words in repeats of at least ``least`` words, and the longest repeat."""
        longest = np.zeros(len(self.sizes), np.int64)
        if not self.total:
            return longest.copy(), longest
        tied = self._tied(self.ranks[-1], np.arange(self.total))
        places = tied
        while len(tied):
            rank, offset = self.ranks[-1], 1 << (len(self.ranks) - 1)
            finer = rank.copy()
            order, group = _dense(self._joined(rank[tied], self._at(rank, tied, offset)))
            # within a group of equal ranks the new ranks count on from the old one
            old = rank[tied[order]]
            new = np.r_[True, old[1:] != old[:-1]]
            begins = np.maximum.accumulate(np.where(new, np.arange(len(old)), 0))
            finer[tied[order]] = old + group - begins
            self.ranks.append(finer)
            tied = self._tied(finer, tied)
            if 2 * offset <= least:
                places = tied
        order = places[np.argsort(self.ranks[-1][places], kind="stable")]
        shared = self._common(order[:-1], order[1:])
        depth = np.maximum(np.r_[0, shared], np.r_[shared, 0])[: len(order)]
        spans, depth = order[depth >= least], depth[depth >= least]
        if len(spans):
            owner = np.searchsorted(self.first + self.sizes, spans, "right")
            np.maximum.at(longest, owner, depth)
        return self._summed(self._covered(spans, depth)), longest

    def _common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The length of the common prefix of each pair of suffixes, from the ranks of all levels."""
        length = np.zeros(len(one), np.int64)
        one, two = one.copy(), two.copy()
        inside = np.ones(len(one), bool)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            same = inside & (rank[one] == rank[two])
            length[same] += 1 << level
            for place in (one, two):
                inside &= ~same | (self.left[place] > 1 << level)
            step = same & inside
            one[step] += 1 << level
            two[step] += 1 << level
        return length

    def _covered(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        change = np.bincount(starts, minlength=self.total + 1)
        change -= np.bincount(starts + lengths, minlength=self.total + 1)
        return np.cumsum(change)[: self.total] > 0

    def _summed(self, marks: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(marks)]
        return sums[self.first + self.sizes] - sums[self.first]


def _measured(texts: list[bytes], least: int, covered: int, longest: int) -> dict[str, np.ndarray]:
    repeats = Repeats([text.split() for text in texts])
    table = np.array(
        [np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _BYTE_WEIGHTS.T for t in texts]
    ).reshape(-1, 2)
    found = {
        "n_words": repeats.sizes,
        "word_chars": table[:, 0],
        "n_symbols": table[:, 1],
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeats.triples(),
    }
    found["n_covered_words"], found["longest_repeat"] = repeats.maximal(least)
    few = found["n_words"] < MIN_WORDS
    found["base_failed"] = few | (
        100 * found["n_repeat_words"] > MAX_REPEATED_WORDS * found["n_words"]
    )
    found["kept"] = ~(
        found["base_failed"]
        | (100 * found["n_covered_words"] > covered * found["n_words"])
        | (found["longest_repeat"] > longest)
    )
    return found


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: int = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Counts and verdict of each row: ``key`` and the columns of ``SCHEMA``.

    Words are runs of other than ASCII white space. A null or empty text has no
    words and fails by its length. Rows may repeat, keys may be null; each row is
    judged for itself. An empty table gives no rows; other columns are ignored. A text
    is held whole: its ranks take four bytes a word for each doubling of its longest
    repeat, so only a long text that repeats itself throughout takes many of them.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = _measured(texts, min_repeat, max_covered, max_repeat)
            columns = [part.column("key"), *[pa.array(values) for values in found.values()]]
            names = ["key", *found]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = [name.strip().split(" ")[0] for name in SCHEMA.split(",")]
    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(judged, f"key {kind}, {SCHEMA}")
    return found.select(F.col("key").alias(key), *order)
