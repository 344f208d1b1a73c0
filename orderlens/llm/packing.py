"""Packing of tokenized documents into sequences of a fixed length.

Documents are tokenized once, in Arrow batches whose different words are looked
up once each, and only lengths and checksums go further. The lengths are packed
by a linear grouping scheme: the histogram of lengths, which has at most
``capacity`` rows however many documents there are, is cut into groups of equal
cardinality above ``SMALL_PART`` of the capacity; each length counts as the
largest of its group, and the few sizes left are packed optimally by a linear
program over configurations (column generation with a knapsack). The pieces are
dealt by hash over cells of about ``CELL_PIECES``. Each cell fills its share of
the configurations with its actual pieces, but for the smallest place of each,
as actual pieces leave more room than rounded ones; what is left then goes where
it fits best, the small ones last. A cell costs at most a few sequences more
than one packing of everything would.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderlens.llm.workspace import parts_of, written

CAPACITY = 2048
END_ID = 0
GROUPS = 64
SMALL_PART = 8
CELL_PIECES = 1 << 16
# Texts whose ids a task remembers, of each kind, and the longest of them.
MEMORY_TEXTS = 400_000
MEMORY_CHARS = 64
# Letters that normalization only lower-cases, and signs but the apostrophe (which may take a letter).
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]))
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
PLAIN_WORD = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*[!-&(-/:-@\[-`{-~]*\z"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Remembered(dict):
    """What ``find`` gives for a text, found once for short ones; forgotten when there are too many."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) <= MEMORY_CHARS:
            if len(self) >= MEMORY_TEXTS:
                self.clear()
            self[text] = found
        return found


class WordIds:
    """Ids of texts, from those of their white-space separated words.

    The pre-tokenizer never joins text across white space, so a text's ids are
    those of its words one after the other. Only characters that every Unicode
    version counts as white space separate words here. A word of plain letters and
    signs behind them is two pre-tokens, whose ids the model gives without
    normalization; any other word goes the whole way. The words of many texts are
    cut and told apart together, and each different one is looked at once.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        require_plain_words(self.tokenizer)
        self.model = self.tokenizer.model
        self.tokens = Remembered(self._token)
        self.words = Remembered(self._word)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, none null, and where each text's ids end."""
        for white in "\n\t\r":
            texts = pc.replace_substring(texts, white, " ")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        ids, count = self._of_words(coded.dictionary)
        ids, ends = joined(ids, count, coded.indices.to_numpy())
        return ids, ends[cut.offsets.to_numpy()[1:] - 1]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each has."""
        plain = pc.match_substring_regex(words, PLAIN_WORD)
        heads = pc.utf8_lower(pc.utf8_rtrim(words, SIGNS))
        tails = pc.utf8_ltrim(words, LETTERS)
        tokens = pa.concat_arrays([pc.if_else(plain, part, "") for part in (heads, tails)]).dictionary_encode()
        found = list(map(self.tokens.__getitem__, tokens.dictionary.to_pylist()))
        code = tokens.indices.to_numpy().reshape(2, len(words)).T.astype(np.int64)
        odd = pc.invert(plain)
        others = words.filter(odd).to_pylist()
        code[odd.to_numpy(zero_copy_only=False), 0] = len(found) + np.arange(len(others))
        found += map(self.words.__getitem__, others)
        count = np.array([len(f) // 4 for f in found], np.int64)
        ids, ends = joined(np.frombuffer(b"".join(found), "<u4"), count, code.ravel())
        return ids, np.diff(ends[1::2], prepend=0)

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _token(self, text: str) -> bytes:
        """The ids of one normalized pre-token."""
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()


def joined(ids: np.ndarray, count: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` (of ``count`` ids each) that ``codes`` name, and where each of them ends."""
    size = count[codes]
    ends = np.cumsum(size)
    shift = (np.cumsum(count) - count)[codes] - (ends - size)
    place = np.repeat(shift, size)
    place += np.arange(len(place))
    return ids[place], ends


def numbered(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place repeated ``count`` times, and the number of each repeat from 0."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)


def require_plain_words(tokenizer: Tokenizer) -> None:
    """Raise unless texts are lower-cased and cut at white space, which is then dropped."""
    rules = json.loads(tokenizer.to_str())
    normalizers = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    cutters = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    split = cutters[0].get("type"), cutters[0].get("behavior"), cutters[0].get("invert")
    ends = rules["model"].get("end_of_word_suffix")
    if normalizers != ["NFC", "Replace", "Lowercase"] or split != ("Split", "Removed", True) or not ends:
        raise ValueError("the vocabulary is not one of lower-case words without white space")


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of each document, its ids ended by ``END_ID``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer)  # forgotten when the task ends
        for part in parts_of(batches):
            ids, ends = known.of(pc.fill_null(part.column("text"), ""))
            ids = np.insert(ids, ends, END_ID).astype("<u4", copy=False)
            ends += np.arange(1, len(ends) + 1)
            size = np.diff(ends, prepend=0)
            rows, number = numbered(-(-size // capacity))
            start = number * capacity
            length = np.minimum(capacity, size[rows] - start)
            first = 4 * ((ends - size)[rows] + start)
            data = memoryview(ids).cast("B")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key").take(pa.array(rows)),
                    pa.array(number, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, sums)],
                ],
                ["key", "piece", "start", "length", "ids_crc32"],
            )
            pa.default_memory_pool().release_unused()  # the words' memory, or the worker keeps it

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(pieces, schema)


# -- configurations ------------------------------------------------------------


def grouped_sizes(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> dict[int, int]:
    """Rounded size to count: the large lengths in groups of equal cardinality.

    Pieces of the full capacity are left out, as they are alone anyway.
    """
    lengths = sorted(n for n in histogram if capacity // SMALL_PART < n < capacity)
    share = sum(histogram[n] for n in lengths) / groups
    sizes: dict[int, int] = {}
    waiting = total = 0
    for n in lengths:
        waiting += histogram[n]
        total += histogram[n]
        if total >= share * (len(sizes) + 1) - 1e-6 or n == lengths[-1]:
            sizes[n], waiting = waiting, 0
    return sizes


def configurations(sizes: dict[int, int], capacity: int) -> list[tuple[float, dict[int, int]]]:
    """How often each configuration (size to number of pieces) is used, by linear programming."""
    if not sizes:
        return []
    size = np.array(list(sizes))
    demand = np.array(list(sizes.values()), float)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(40 * len(size)):
        worth = np.linalg.solve(basis.T, np.ones(len(size)))
        column = _most_worth(size, worth, capacity)
        if worth @ column <= 1 + 1e-7:
            break
        level = np.linalg.solve(basis, demand)
        change = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    level = np.linalg.solve(basis, demand)
    used = np.argsort(-level)
    return [
        (float(level[j]), {int(s): int(n) for s, n in zip(size, basis[:, j]) if n}) for j in used
    ]


def _most_worth(size: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The fitting multiset of sizes of the largest worth; more pieces in each round."""
    best = np.zeros(capacity + 1)
    takes = []
    for _ in range(capacity // int(size.min())):
        more, taken = best.copy(), np.full(capacity + 1, -1)
        for i, (s, w) in enumerate(zip(size, worth)):
            if w > 0:
                value = best[: capacity + 1 - s] + w
                better = value > more[s:]
                more[s:][better] = value[better]
                taken[s:][better] = i
        takes.append(taken)
        best = more
    column, room = np.zeros(len(size), int), capacity
    for taken in reversed(takes):
        if taken[room] >= 0:
            column[taken[room]] += 1
            room -= size[taken[room]]
    return column


def without_smallest(configuration: dict[int, int]) -> dict[int, int]:
    """The configuration less one piece of its smallest size, if it has several pieces."""
    if sum(configuration.values()) == 1:
        return configuration
    smallest = min(configuration)
    return {s: n - (s == smallest) for s, n in configuration.items() if n > (s == smallest)}


# -- one cell ------------------------------------------------------------------


def pack(lengths: np.ndarray, plan: list[tuple[float, dict[int, int]]], capacity: int) -> np.ndarray:
    """The sequence of each piece. ``plan``: configurations with their use in this cell."""
    order = np.argsort(-lengths, kind="stable")
    sequence = np.full(len(lengths), -1, np.int64)
    room: list[np.ndarray] = []
    opened = 0
    large = order[(lengths[order] > capacity // SMALL_PART) & (lengths[order] < capacity)]
    sizes = np.array(sorted({s for _, c in plan for s in c}), np.int64)
    group = np.searchsorted(sizes, lengths[large])
    queues = {int(s): large[group == g] for g, s in enumerate(sizes)}
    for fill_up in (False, True):  # the planned use first, then as often as pieces are left
        for use, configuration in plan:
            times = min(len(queues[s]) // n for s, n in configuration.items())
            if not fill_up:
                times = min(times, int(use))
            free = np.full(times, capacity)
            for s, n in configuration.items():
                chosen, queues[s] = queues[s][: n * times], queues[s][n * times :]
                sequence[chosen] = opened + np.arange(n * times) % max(1, times)
                free -= lengths[chosen].reshape(n, times).sum(axis=0)
            room.append(free)
            opened += times
    left = order[sequence[order] < 0]
    _best_fit(lengths, left, sequence, np.concatenate([np.zeros(0, np.int64), *room]), capacity)
    return sequence


def _best_fit(lengths, left, sequence, room, capacity) -> None:
    """Longest first, each into the fullest sequence with room for it, or into a new one."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    for number, free in enumerate(room.tolist()):
        open_at[free].append(number)
    mask = sum(1 << free for free in range(1, capacity + 1) if open_at[free])
    opened = len(room)
    for piece, length in zip(left.tolist(), lengths[left].tolist()):
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = open_at[free].pop()
            if not open_at[free]:
                mask ^= 1 << free
        else:
            free, number = capacity, opened
            opened += 1
        sequence[piece] = number
        if free > length:
            open_at[free - length].append(number)
            mask |= 1 << (free - length)


def packed(
    pieces: DataFrame, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES, groups: int = GROUPS
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` added. ``pieces`` is read three times."""
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row a length
    histogram = {row["length"]: row["n"] for row in counted}
    total = sum(histogram.values())
    cells = -(-total // cell_pieces) or 1
    plan = [
        (use / cells, without_smallest(configuration))
        for use, configuration in configurations(grouped_sizes(histogram, capacity, groups), capacity)
    ]

    def place(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key", "piece"], ascending=[False, True, True])
        sequence = pack(rows["length"].to_numpy(), plan, capacity)
        rows = rows.assign(sequence_id=(int(cell[0]) << 32) + sequence)
        offset = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.assign(offset=offset).drop(columns="cell")

    schema = f"{pieces.schema.simpleString()[7:-1]}, sequence_id bigint, offset bigint"
    cell = F.pmod(F.xxhash64("key", "piece"), F.lit(cells)).alias("cell")
    return pieces.select("*", cell).groupBy("cell").applyInPandas(place, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    cell_pieces: int = CELL_PIECES,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece.

    A document is its ids and ``END_ID``; only one longer than the capacity is
    cut, into full pieces and a rest. A null or empty text is the one id
    ``END_ID``. Rows may repeat and keys may be null: each row is packed for
    itself. An empty table gives no rows; other columns are ignored. A text of any
    length is tokenized whole, in memory of some fifteen times its size. Vocabularies
    that do not lower-case and drop white space are refused.
    """
    pieces = written(tokenized_pieces(docs, tokenizer, key, text, capacity), "pieces")
    return packed(pieces, capacity, cell_pieces).withColumnRenamed("key", key)
