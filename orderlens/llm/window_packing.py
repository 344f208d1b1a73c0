"""Packing of tokenized documents into full windows by non-negative least squares.

Documents are tokenized once and their ids stored. Pieces of the full capacity
are windows of their own; the histogram of the rests, in bins of ``STEP`` tokens,
is on the driver, as it has at most ``capacity`` rows however many documents
there are. Shallow combinations of at most ``DEPTH`` bins that fill a window are
enumerated, and non-negative least squares finds how often each is repeated to
come closest to the histogram.

The stored rows are then packed where they lie, without a shuffle, in runs of at
most ``RUN_ROWS`` documents: each run repeats the combinations as often as its
share of the counts, rounded, and its own documents allow. The documents left go
greedily where they fit best, and new windows are opened for those that fit
nowhere. As documents may be cut, the emptiest windows of a run are then taken
apart to fill the others up; what remains makes full windows and, at last,
windows of powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderlens.llm.workspace import parts_of, written

CAPACITY = 2048
END_ID = 1
STEP = 16
DEPTH = 4
RUN_ROWS = 8192
RUN_TOKENS = 4 << 20
# Text bytes tokenized together.
SLICE_BYTES = 8 << 20

# Fixed value: how the vocabulary's pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space before another white space or at the end belongs to a longer run of white space.
SPACES = "[ ](?:[\t-\r \x85\xa0  -     　]|$)"


# -- tokens --------------------------------------------------------------------


class ByteLevelIds:
    """Ids of texts by a byte-level vocabulary.

    A space before a character that is no white space begins a new pre-token, so a
    text is its parts cut there, one after the other. The different parts of many
    texts are tokenized once, joined, and told apart by the bytes of their tokens.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        cutter = self.whole.pre_tokenizer
        plain = type(cutter).__name__ == "ByteLevel" and not cutter.add_prefix_space and cutter.use_regex
        if self.whole.normalizer is not None or not plain:
            raise ValueError("the vocabulary is not byte-level without normalization")
        vocabulary = self.whole.get_vocab()
        added = self.whole.get_added_tokens_decoder()
        letters = {letter: byte for byte, letter in byte_letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i not in added}
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.kind = np.dtype("<u2" if len(self.sizes) <= 1 << 16 else "<u4")
        # ids in the order of the merges, so both libraries' models agree
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [token.content for token in added.values()]
        odd = [SPACES, *map(re.escape, self.special)]
        self.odd = "|".join(odd)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, none null, and where each text's ids end."""
        odd = pc.match_substring_regex(texts, self.odd)
        plain = pc.if_else(odd, "", texts)
        parts = pc.split_pattern(plain, " ")
        first = parts.offsets.to_numpy()[:-1].astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
        code[first] = len(words) + np.arange(len(first))
        ids, count = self._joined(words)
        heads = []
        for text, part, at in zip(texts, coded.indices.take(pa.array(first)), odd):
            heads.append(self._alone(text.as_py() if at.as_py() else words[part.as_py()]))
        ids = np.concatenate([ids, *heads])
        count = np.concatenate([count, [len(h) for h in heads]]).astype(np.int64)
        begin = np.cumsum(count) - count
        size = count[code]
        ends = np.cumsum(size)
        place = np.repeat(begin[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        last = np.append(first[1:], len(code)) - 1
        return ids[place], ends[last]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, each after a space, and how many each has."""
        ids = np.array(self.fast.encode_ordinary("".join([" " + w for w in words])), np.int64)
        bounds = np.cumsum([1 + len(w.encode()) for w in words])
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), bounds, "left") + 1
        return ids.astype(self.kind), np.diff(ends, prepend=0)

    def _alone(self, text: str) -> np.ndarray:
        if any(token in text for token in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)
        return np.array(self.fast.encode_ordinary(text), self.kind)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``tokens`` (their number, with the end) and ``ids``, in ``width`` bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ByteLevelIds(tokenizer)
        width = known.kind.itemsize
        for part in parts_of(batches, SLICE_BYTES):
            ids, ends = known.of(pc.fill_null(part.column("text"), ""))
            ids = np.insert(ids, ends, END_ID)
            ends = ends + np.arange(1, len(ends) + 1)
            offsets = pa.py_buffer((np.append(0, ends) * width).astype("<i4"))
            stored = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids)])
            columns = [
                part.column("key"),
                pa.array(np.diff(ends, prepend=0), pa.int64()),
                pa.array(np.full(len(ends), width), pa.int32()),
                stored,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "tokens", "width", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"key {kind}, tokens bigint, width int, ids binary")


# -- combinations --------------------------------------------------------------


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """Every way to write ``bins`` as a sum of at most ``depth`` numbers, ascending, zeros first."""
    found = np.array([[bins]])
    rows = [found]
    for _ in range(depth - 1):
        # split the largest number into one no smaller than the others and a rest no smaller than that
        low = found[:, -2] if found.shape[1] > 1 else np.ones(len(found), int)
        count = np.maximum(0, found[:, -1] // 2 - low + 1)
        which = np.repeat(np.arange(len(found)), count)
        part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
        found = np.column_stack([found[which, :-1], part, found[which, -1] - part])
        rows.append(found)
    return np.concatenate([np.pad(r, ((0, 0), (depth - r.shape[1], 0))) for r in rows])


def repeats(columns: np.ndarray, demand: np.ndarray, limit: int = 10_000) -> np.ndarray:
    """The non-negative counts of the columns whose sum comes closest to ``demand``, by active sets.

    ``columns`` hold the places that each column adds one to; place 0 is no place.
    """
    scale = max(1.0, float(demand.max(initial=0)))
    target = np.r_[0.0, demand[1:] / scale]

    def dense(chosen: list[int]) -> np.ndarray:
        matrix = np.zeros((len(target), len(chosen)))
        for j, c in enumerate(chosen):
            np.add.at(matrix[:, j], columns[c], 1.0)
        matrix[0] = 0
        return matrix

    active: list[int] = []
    matrix = dense(active)
    level = np.zeros(0)
    barred: set[int] = set()
    for _ in range(limit):
        left = target - matrix @ level
        gain = left[columns].sum(axis=1)
        gain[active] = -np.inf
        gain[list(barred)] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            break
        active.append(best)
        matrix = np.column_stack([matrix, dense([best])])
        level = np.r_[level, 0.0]
        while True:
            wanted = np.linalg.lstsq(matrix, target, rcond=None)[0]
            if wanted.min() > 1e-12:
                level = wanted
                barred.clear()
                break
            if active[-1] == best and level[-1] == 0 and wanted[-1] <= 1e-12:
                barred.add(best)  # rounding only: it would not enter
            falls = wanted <= 1e-12
            step = np.min(level[falls] / np.maximum(level[falls] - wanted[falls], 1e-300))
            level = np.maximum(0, level + step * (wanted - level))
            kept = ~(falls & (level <= 1e-12))
            active = [a for a, k in zip(active, kept) if k]
            matrix, level = matrix[:, kept], level[kept]
            if not active:
                break
    result = np.zeros(len(columns))
    result[active] = level * scale
    return result


Plan = list[tuple[float, dict[int, int]]]


def planned(histogram: dict[int, int], capacity: int = CAPACITY, step: int = STEP, depth: int = DEPTH) -> Plan:
    """Combinations, as bins and how many of each, with their repeats for one document of the corpus."""
    bins = capacity // step
    demand = np.zeros(bins + 1)
    for length, n in histogram.items():
        demand[-(-length // step)] += n
    columns = combinations(bins, depth)
    used = repeats(columns, demand)
    total = max(1, sum(histogram.values()))
    plan = []
    for c in np.argsort(-used):
        if used[c] <= 0:
            break
        sizes, counts = np.unique(columns[c][columns[c] > 0], return_counts=True)
        plan.append((float(used[c]) / total, dict(zip(sizes.tolist(), counts.tolist()))))
    return plan


# -- one run -------------------------------------------------------------------

Piece = tuple[int, int, int]  # document, start, length


def placed(
    rests: np.ndarray, starts: np.ndarray, plan: Plan, capacity: int = CAPACITY, step: int = STEP
) -> list[list[Piece]]:
    """Sequences of pieces that hold the rests; each fills the capacity or a power of two.

    ``rests`` are the lengths, from 1 to the capacity, and ``starts`` their places in the documents.
    """
    windows, left = _combined(rests, plan, capacity, step)
    room = [capacity - int(rests[w].sum()) for w in windows]
    _greedy(rests, left, windows, room, capacity)
    whole = [[(d, int(starts[d]), int(rests[d])) for d in window] for window in windows]
    return _filled(whole, room, capacity)


def _combined(rests: np.ndarray, plan: Plan, capacity: int, step: int) -> tuple[list[list[int]], list[int]]:
    """Windows by the plan, and the documents left, the longest first."""
    order = np.argsort(-rests, kind="stable")
    bins = -(-rests[order] // step)
    queues = {b: order[bins == b].tolist() for b in range(1, capacity // step + 1)}
    windows: list[list[int]] = []
    for share, combination in plan:
        possible = min(len(queues[b]) // n for b, n in combination.items())
        times = min(round(share * len(rests)), possible)
        chosen = []
        for b, n in combination.items():
            chosen.append(np.array(queues[b][: n * times]).reshape(n, times))
            del queues[b][: n * times]
        if times:
            windows += np.concatenate(chosen).T.tolist()
    return windows, [d for b in sorted(queues, reverse=True) for d in queues[b]]


def _greedy(rests: np.ndarray, left: list[int], windows: list[list[int]], room: list[int], capacity: int) -> None:
    """Longest first, each document into the fullest window with room for it, or into a new one."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    for number, free in enumerate(room):
        open_at[free].append(number)
    mask = sum(1 << free for free in range(1, capacity + 1) if open_at[free])
    for document in left:
        length = int(rests[document])
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = open_at[free].pop()
            if not open_at[free]:
                mask ^= 1 << free
            windows[number].append(document)
        else:
            free, number = capacity, len(windows)
            windows.append([document])
            room.append(capacity)
        room[number] = free - length
        if free > length:
            open_at[free - length].append(number)
            mask |= 1 << (free - length)


def _filled(windows: list[list[Piece]], room: list[int], capacity: int) -> list[list[Piece]]:
    """The emptiest windows taken apart to fill up the others, the last ones to powers of two."""
    order = sorted(range(len(windows)), key=room.__getitem__)
    gaps, held, kept = sum(room), 0, len(order)
    while kept and held < gaps:
        kept -= 1
        gaps -= room[order[kept]]
        held += capacity - room[order[kept]]
    loose = [piece for number in order[kept:] for piece in windows[number]]
    loose.sort(key=lambda piece: piece[2])

    def take(size: int) -> list[Piece]:
        """The longest loose pieces, the last one cut, of ``size`` in all."""
        found = []
        while size:
            document, start, length = loose.pop()
            cut = min(size, length)
            found.append((document, start, cut))
            if cut < length:
                loose.append((document, start + cut, length - cut))
            size -= cut
        return found

    result = [windows[number] + take(room[number]) for number in order[:kept]]
    over = held - gaps
    sizes = [capacity] * (over // capacity)
    sizes += [1 << bit for bit in reversed(range(capacity.bit_length())) if over % capacity >> bit & 1]
    return result + [take(size) for size in sizes]


# -- all runs ------------------------------------------------------------------

COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(stored: DataFrame, capacity: int = CAPACITY, step: int = STEP, depth: int = DEPTH) -> DataFrame:
    """One row a piece of the ``stored`` documents, which are read twice: lengths alone, then all."""
    if capacity & (capacity - 1) or capacity % step:
        raise ValueError("the capacity must be a power of two and a multiple of the step")
    rest = (F.col("tokens") % capacity).cast("int").alias("rest")
    counted = stored.groupBy(rest).agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    plan = planned({r["rest"]: r["n"] for r in counted if r["rest"]}, capacity, step, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for run in _runs(batches):
            batch, number = _pieces(run, plan, number, capacity, step)
            yield batch

    kind = stored.schema["key"].dataType.simpleString()
    return stored.mapInArrow(place, f"key {kind}, {COLUMNS}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows, at most RUN_ROWS of at most RUN_TOKENS but for one longer document."""
    waiting: list[pa.RecordBatch] = []
    rows = tokens = 0
    for batch in batches:
        ends = np.cumsum(batch.column("tokens").to_numpy())
        start, count = 0, batch.num_rows
        while start < count:
            before = ends[start - 1] if start else 0
            fits = int(np.searchsorted(ends, before + RUN_TOKENS - tokens, "right"))
            stop = min(max(fits, start), start + RUN_ROWS - rows, count)
            if stop == start and not rows:
                stop = start + 1
            if stop > start:
                waiting.append(batch.slice(start, stop - start))
                rows += stop - start
                tokens += int(ends[stop - 1] - before)
                start = stop
            if start < count:
                yield pa.Table.from_batches(waiting)
                waiting, rows, tokens = [], 0, 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _pieces(run: pa.Table, plan: Plan, number: int, capacity: int, step: int) -> tuple[pa.RecordBatch, int]:
    tokens = run.column("tokens").to_numpy()
    width = run.column("width")[0].as_py()
    ids = [memoryview(i.as_buffer()) for chunk in run.column("ids").chunks for i in chunk]
    full, rests = tokens // capacity, tokens % capacity
    rows = np.repeat(np.arange(len(tokens)), full)
    piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
    sequences = [[(d, capacity * p, capacity)] for d, p in zip(rows.tolist(), piece.tolist())]
    some = np.flatnonzero(rests)
    for window in placed(rests[some], (full * capacity)[some], plan, capacity, step):
        sequences.append([(int(some[d]), start, length) for d, start, length in window])
    found: list[tuple] = []
    for pieces in sequences:
        offset = 0
        for document, start, length in pieces:
            cut = np.frombuffer(ids[document][start * width : (start + length) * width], f"<u{width}")
            found.append((document, start, length, zlib.crc32(cut.astype("<u4")), number, offset))
            offset += length
        number += 1
    columns = [pa.array(c, pa.int64()) for c in zip(*found)]
    key = run.column("key").combine_chunks().take(columns[0])
    of = pa.array(tokens[columns[0].to_numpy()], pa.int64())
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([key, *columns[1:4], of, *columns[4:]], names), number


def pack_windows(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    step: int = STEP,
    depth: int = DEPTH,
) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row a piece.

    A document is its ids and ``END_ID``; each id is in one piece. A sequence fills
    the capacity or a power of two below it. A null or empty text is the one id
    ``END_ID``. Rows may repeat and keys may be null: each row is packed for itself.
    A text of any length is tokenized whole, in memory of some ten times its size.
    An empty table gives no rows; other columns are ignored. Only byte-level
    vocabularies are accepted.
    """
    stored = written(tokenized(docs, tokenizer, key, text), "ids")
    return packed(stored, capacity, step, depth).withColumnRenamed("key", key)
