"""Sampled SentencePiece encoding, and decoding.

All segmentations of a text into pieces form a lattice. Going forward, every
place sums the weights of all ways to reach it (forward filtering); going
backward from the end, each step draws the last piece with its probability given
the place (backward sampling). That draws segmentations exactly in proportion to
the product of their pieces' weights. No piece continues from a word into white
space, so the lattice falls apart there: the filtered lattice of a word with the
spaces before it is remembered, and all words of a run of texts are sampled
together. Draws come from a counter-based generator over the row's key, the
word's place and the step, so a row's segmentation depends on nothing else.

A merge-based model has ranks instead of probabilities, so a piece weighs
``(1 + rank) ** -smoothing``, whatever the kind of model.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from orderlens.llm.workspace import column_of, slices, whole_rows

SMOOTHING = 0.7
SEED = 17
SPACE = "▁"
# Edges of the lattices a task remembers, some 30 bytes each, and the longest word remembered.
MEMORY_EDGES = 1_500_000
MEMORY_CHARS = 48
# Text bytes sampled in one go, and rows decoded in one go.
RUN_BYTES, RUN_ROWS = 1 << 20, 500
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TINY, _HUGE, _BEYOND = 1e-150, 1e150, float("inf")


class Pieces:
    """The pieces of a model that stand for text, with their weights, and the byte pieces."""

    def __init__(self, path: str, smoothing: float):
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        order = sorted(range(size), key=lambda i: (-model.get_score(i), i))
        weight = {i: (1.0 + rank) ** -smoothing for rank, i in enumerate(order)}
        self.byte_ids = [-1] * 256
        self.text: dict[str, tuple[float, int]] = {}
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[model.id_to_piece(i).replace(SPACE, " ")] = (weight[i], i)
        if -1 in self.byte_ids:
            raise ValueError("lossless encoding needs a model with all byte pieces")
        texts = [t for t in self.text if len(t) > 1]
        if any(" " in t.lstrip(" ") for t in texts):
            raise ValueError("a piece of this model goes on after a space")
        self.byte_weight = (1.0 + size) ** -smoothing
        self.single = frozenset(t for t in self.text if len(t) == 1)
        # also all beginnings, so that a search knows when to end
        self.longest = max(map(len, self.text))
        for t in texts:
            for end in range(1, len(t)):
                self.text.setdefault(t[:end], (0.0, -1))
        self.split = self._splitting(texts)
        self.tables = [self._table(length) for length in range(1, self.longest + 1)]

    def _table(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes, in order, of all pieces and beginnings of a length; their weights and ids."""
        found = [(t, *hit) for t, hit in self.text.items() if len(t) == length]
        codes = np.array([[ord(c) for c in t] for t, _, _ in found], np.uint64).reshape(-1, length)
        hashes = np.zeros(len(found), np.uint64)
        for column in codes.T:
            hashes = hashes * _BASE + column + np.uint64(1)
        order = np.argsort(hashes)
        weight, piece = (np.array([row[i] for row in found])[order] for i in (1, 2))
        return hashes[order], weight, piece.astype(np.int32)

    @staticmethod
    def _splitting(texts: list[str]) -> str:
        """A pattern for words between which no piece reaches.

        A piece begins, but never goes on, after a space. Letters are cut from the
        sign behind them if no piece holds the last letter and that sign together.
        """
        held: dict[str, set[str]] = {sign: set() for sign in punctuation}
        for text in texts:
            for letter, sign in zip(text, text[1:]):
                if sign in held and re.match(r"[^\W\d_]", letter):
                    held[sign].add(letter)
        free = "".join(sign for sign in held if not held[sign])
        cuts = [f"[{re.escape(free)}]"] if free else []
        cuts += [f"(?<![{''.join(sorted(held[s]))}]){re.escape(s)}" for s in held if held[s]]
        line = r"\n" if not any("\n" in t for t in texts) else ""
        alone = r"\n|" if line else ""
        return rf"{alone} *+[^\W\d_]++(?={'|'.join(cuts)})| *[^ {line}]+| +"


class Lattices(dict):
    """For each word the last node of its filtered lattice.

    The edges into a node are in ``first[node]`` and following places, those of
    long pieces first. ``upto`` sums their weights, up to ``reach[node]``;
    ``piece`` and ``back`` say what they emit and where they come from (-1: the
    word's beginning). When there are too many, the lattices of the words used
    most stay and the others go.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.words = re.compile(pieces.split).findall
        self.first, self.reach = array("i"), array("d")
        self.upto, self.piece, self.back = array("d"), array("i"), array("i")
        self.uses = np.zeros(0, np.int64)
        self.fresh: list[str] = []
        self.kept: list[str] = []
        self.node_starts, self.edge_starts = array("i"), array("i")

    def _forget(self) -> None:
        words = self.kept
        first, upto, piece, back = (np.array(x) for x in (self.first, self.upto, self.piece, self.back))
        nodes, edges = np.array(self.node_starts), np.array(self.edge_starts)
        ends = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        # nodes and edges of a word stand together, its last node's edges last
        sizes = ends + 1 - nodes
        counts = np.r_[first, len(upto)][ends + 1] - edges
        order = np.argsort(-self.uses[ends], kind="stable")
        order = order[(self.uses[ends[order]] > 1) & (np.cumsum(counts[order]) <= MEMORY_EDGES // 2)]
        sizes, counts, nodes, edges, ends = (x[order] for x in (sizes, counts, nodes, edges, ends))
        new_nodes, new_edges = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
        node = np.repeat(nodes - new_nodes, sizes) + np.arange(sizes.sum())
        edge = np.repeat(edges - new_edges, counts) + np.arange(counts.sum())
        back = np.where(back[edge] < 0, -1, back[edge] - np.repeat(nodes - new_nodes, counts))
        self.first = array("i", (first[node] - np.repeat(edges - new_edges, sizes)).astype("i").tobytes())
        self.reach = array("d", np.array(self.reach)[node].tobytes())
        self.upto, self.piece = array("d", upto[edge].tobytes()), array("i", piece[edge].tobytes())
        self.back = array("i", back.astype("i").tobytes())
        self.uses = self.uses[node] // 2
        self.kept = [words[i] for i in order.tolist()]
        self.node_starts = array("i", new_nodes.astype("i").tobytes())
        self.edge_starts = array("i", new_edges.astype("i").tobytes())
        self.clear()
        self.update(zip(self.kept, (new_nodes + sizes - 1).tolist()))

    def __missing__(self, word: str) -> int:
        """A number below zero for a word yet to be learned."""
        self.fresh.append(word)
        self[word] = number = -len(self.fresh)
        return number

    def _learn(self) -> np.ndarray:
        """Store the lattices of the fresh words; the last node of each."""
        words, self.fresh = self.fresh, []
        single = self.pieces.single
        plain = np.array([len(w) <= MEMORY_CHARS and single.issuperset(w) for w in words], bool)
        last = np.empty(len(words), np.int64)
        together = [w for w, p in zip(words, plain) if p]
        if together:
            last[plain] = self._filtered_together(together)
        for i in np.flatnonzero(~plain).tolist():
            nodes, edges = len(self.first), len(self.upto)
            last[i] = self._filtered(words[i])
            if len(words[i]) <= MEMORY_CHARS:
                self.kept.append(words[i])
                self.node_starts.append(nodes)
                self.edge_starts.append(edges)
            else:
                del self[words[i]]
        self.update((w, n) for w, n in zip(words, last.tolist()) if len(w) <= MEMORY_CHARS)
        return last

    def _filtered_together(self, words: list[str]) -> np.ndarray:
        """The lattices of words whose characters are all pieces, so that every place is a node."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in words])
        stop = np.cumsum(sizes)
        begin = stop - sizes
        inside = np.arange(len(codes)) - np.repeat(begin, sizes)
        left = np.repeat(sizes, sizes) - inside
        alive, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        parts = []
        for length, (known, weight, piece) in enumerate(self.pieces.tables, 1):
            fits = left[alive] >= length
            alive, hashes = alive[fits], hashes[fits]
            hashes = hashes * _BASE + codes[alive + length - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            alive, hashes, at = alive[hit], hashes[hit], at[hit]
            whole = weight[at] > 0
            parts.append((alive[whole], alive[whole] + length - 1, weight[at[whole]], piece[at[whole]]))
        start, end, weight, piece = (np.concatenate(x) for x in zip(*parts))
        # forward: each edge takes what reaches its start, places in the order of their words
        turn = np.argsort(inside[start], kind="stable")
        bounds = np.searchsorted(inside[start[turn]], np.arange(sizes.max() + 1))
        reach = np.zeros(len(codes))
        for place, (low, high) in enumerate(zip(bounds, bounds[1:])):
            some = turn[low:high]
            if place:
                weight[some] *= reach[start[some] - 1]
            np.add.at(reach, end[some], weight[some])
        order = np.lexsort((start, end))
        start, end, piece = start[order], end[order], piece[order]
        summed = np.cumsum(weight[order] / reach[end])
        first = np.searchsorted(end, np.arange(len(codes)))
        upto = summed - np.r_[0.0, summed][first][end]
        upto[np.r_[first[1:], len(end)] - 1] = _BEYOND
        nodes, edges = len(self.first), len(self.upto)
        back = np.where(inside[start] > 0, nodes + start - 1, -1)
        self.first.frombytes((edges + first).astype("i").tobytes())
        self.reach.frombytes(np.ones(len(codes)).tobytes())
        self.upto.frombytes(upto.tobytes())
        self.piece.frombytes(piece.astype("i").tobytes())
        self.back.frombytes(back.astype("i").tobytes())
        self.kept += words
        self.node_starts.frombytes((nodes + begin).astype("i").tobytes())
        self.edge_starts.frombytes((edges + first[begin]).astype("i").tobytes())
        return nodes + stop - 1

    def _filtered(self, word: str) -> int:
        """Store the lattice of any word; its last node."""
        get, longest, byte_ids = self.pieces.text.get, self.pieces.longest, self.pieces.byte_ids
        new_first, new_reach = self.first.append, self.reach.append
        new_upto, new_piece, new_back = self.upto.append, self.piece.append, self.back.append
        node, edge, size = len(self.first), len(self.upto), len(word)
        into: list = [None] * (size + 1)
        origin, here = -1, 1.0
        for start in range(size + 1):
            if start:
                edges = into[start]
                if edges is None:
                    continue
                new_first(edge)
                edge += len(edges)
                here = 0.0
                for weight, came, piece in edges:
                    here += weight
                    new_upto(here)
                    new_piece(piece)
                    new_back(came)
                self.upto[-1] = _BEYOND
                new_reach(here)
                origin = node
                node += 1
                if start == size:
                    return origin
            stop = min(size, start + longest) + 1
            if here < _TINY:
                here *= _HUGE
                for end in range(start + 1, stop):
                    if into[end]:
                        into[end] = [(w * _HUGE, o, p) for w, o, p in into[end]]
            single = False
            for end in range(start + 1, stop):
                hit = get(word[start:end])
                if hit is None:
                    break
                weight, piece = hit
                if weight:
                    if end == start + 1:
                        single = True
                    edges = into[end]
                    if edges is None:
                        into[end] = [(here * weight, origin, piece)]
                    else:
                        edges.append((here * weight, origin, piece))
            if not single:  # one node after each byte but the last
                weight, came = here, origin
                *early, last = word[start].encode()
                for value in early:
                    new_first(edge)
                    new_reach(1.0)
                    new_upto(_BEYOND)
                    new_piece(byte_ids[value])
                    new_back(came)
                    came, node, edge = node, node + 1, edge + 1
                    weight *= self.pieces.byte_weight
                final = (weight * self.pieces.byte_weight, came, byte_ids[last])
                into[start + 1] = [*(into[start + 1] or []), final]
        raise AssertionError("unreachable")

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """The sampled ids of each text; ``keys`` start their random numbers."""
        if len(self.upto) > MEMORY_EDGES:
            self._forget()
        split = [self.words(f" {text}") if text else [] for text in texts]
        sizes = np.array([len(words) for words in split], np.int64)
        total = int(sizes.sum())
        node = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, total)
        if self.fresh:
            node = np.where(node < 0, self._learn()[-1 - np.minimum(node, -1)], node)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.first) - len(self.uses), np.int64)])
        self.uses += np.bincount(node, minlength=len(self.first))
        ids, ends = self._drawn(node, keys, sizes)
        cuts = np.r_[0, ends][np.cumsum(sizes)]
        return np.split(ids, cuts[:-1])

    def _drawn(self, node: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's end."""
        first, reach = np.frombuffer(self.first, "i"), np.frombuffer(self.reach, "d")
        upto, piece = np.frombuffer(self.upto, "d"), np.frombuffer(self.piece, "i")
        back = np.frombuffer(self.back, "i")
        total = len(node)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        state = _mixed(np.repeat(keys, sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        active = np.arange(total)
        count = np.zeros(total, np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            draw = _mixed(state[active] + np.uint64(len(steps))) >> np.uint64(11)
            draw = draw.astype(np.float64) * 2.0**-53 * reach[node]
            edge = first[node]
            beyond = np.flatnonzero(draw >= upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[draw[beyond] >= upto[edge[beyond]]]
            steps.append((active, piece[edge]))
            count[active] += 1
            node = back[edge]
            going = node >= 0
            active, node = active[going], node[going]
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if total else 0, np.int32)
        for step, (words, drawn) in enumerate(steps):
            ids[ends[words] - 1 - step] = drawn
        return ids, ends


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _pieces(path: str, smoothing: float) -> Pieces:
    """The model, which a worker keeps; lattices are forgotten when a task ends."""
    return Pieces(path, smoothing)


@lru_cache(maxsize=1)
def _piece_bytes(path: str) -> list[bytes]:
    """What each piece stands for."""
    model = SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            found.append(b"")
        else:
            found.append(piece.replace(SPACE, " ").encode())
    return found


def _row_keys(keys: pa.Array, seed: int) -> np.ndarray:
    names = [str(k).encode() for k in keys.to_pylist()]
    return np.array([xxhash.xxh3_64_intdigest(k, seed) for k in names], np.uint64)


def _text_of(ids: list[int], table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).removeprefix(b" ").decode()


def encode(
    docs: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    smoothing: float = SMOOTHING,
    seed: int = SEED,
) -> DataFrame:
    """``row`` (all columns of docs) and ``ids``, a sampled segmentation of the text.

    The same key, text, seed and smoothing give the same ids, on any partitioning;
    rows with the same key draw alike, and a null key is a key like any other. A
    null text has null ids and an empty one none. Other texts begin with a space
    that decoding takes away; characters without a piece become bytes. An empty
    table gives no rows.
    """
    rows = whole_rows(docs)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lattices(_pieces(model, smoothing))
        key_of, text_of = column_of("row", key), column_of("row", text)
        for part, texts in slices(batches, text_of, RUN_BYTES):
            keys = _row_keys(key_of(part), seed)
            ids = known.sample([t.decode() for t in texts], keys)
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            missing = text_of(part).is_null()
            found = pa.ListArray.from_arrays(offsets, values, mask=missing)
            yield pa.RecordBatch.from_arrays([part.column("row"), found], ["row", "ids"])

    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(sampled, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``row`` (all columns of rows) and ``decoded``, the text of the ids.

    Null ids give null, no ids the empty text. Ids of control pieces stand for
    nothing; null ids within a list and ids beyond the model are errors.
    """
    whole = whole_rows(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _piece_bytes(model)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):
                part = batch.slice(at, RUN_ROWS)
                texts = []
                for row in column_of("row", ids)(part):
                    found = None
                    if row.is_valid:
                        found = _text_of(row.values.to_numpy().tolist(), table)
                    texts.append(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string())], ["row", "decoded"]
                )

    schema = T.StructType([*whole.schema.fields, T.StructField("decoded", T.StringType())])
    return whole.mapInArrow(joined, schema)


def round_trip(
    docs: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    smoothing: float = SMOOTHING,
    seed: int = SEED,
) -> DataFrame:
    """``key, n_pieces, ids_hash, decoded_sha256, lossless`` of each row, as `encode` and `decode` give them.

    Both are done in one step, a run of texts at a time, so that neither texts nor
    ids travel between workers.
    """

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Lattices(_pieces(model, smoothing)), _piece_bytes(model)
        for part, texts in slices(batches, limit=RUN_BYTES):
            ids = known.sample([t.decode() for t in texts], _row_keys(part.column("key"), seed))
            missing = part.column("text").is_null().to_pylist()
            counts, hashes, digests, same = [], [], [], []
            for own, source, no_text in zip(ids, texts, missing):
                decoded = b"" if no_text else _text_of(own.tolist(), table).encode()
                counts.append(None if no_text else len(own))
                hashes.append(None if no_text else xxhash.xxh3_64_intdigest(own.astype("<i4").tobytes(), SEED))
                digests.append(None if no_text else sha256(decoded).hexdigest())
                same.append(decoded == source)
            columns = [
                part.column("key"),
                pa.array(counts, pa.int64()),
                pa.array(hashes, pa.uint64()).view(pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(same),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", *names])

    names = ["n_pieces", "ids_hash", "decoded_sha256", "lossless"]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_pieces bigint, ids_hash bigint, decoded_sha256 string, lossless boolean"
    return rows.mapInArrow(tried, schema).withColumnRenamed("key", key)
