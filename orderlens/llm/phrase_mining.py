"""Phrase collocations, counted by prefix-free parsing.

Every piece of a text is parsed into overlapping chunks: a window of ``LONGEST -
1`` words whose hash is divisible by ``TRIGGER`` ends one chunk and begins the
next, so equal passages give equal chunks wherever they stand. The dictionary of
different chunks with their frequencies stands for the corpus. Phrases are
counted inside the chunks of the dictionary, weighted by frequency; a phrase
belongs to the chunk in which it begins before the closing window, so those in
an overlap count once.

Two passes go over the dictionary. The first adds up hashes of word pairs, which
can only count too many; those that reach the least frequency are marked in a
table of ``MARKS`` bits. The second counts, as texts, all words and the phrases
of which every pair is marked. Hashes and marks thus decide what need not be
shuffled, never a result, at every size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.anchors import mixed
from orderlens.llm.workspace import parts_of, written

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
# One window in so many ends a chunk.
TRIGGER = 16
# Bits of the table of frequent pairs, a power of two: 8 MB.
MARKS = 1 << 26
# Words of the dictionary counted together, and the bytes they come in at most.
RUN_BYTES = 12 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_IN_WORD = ~_ENDS_PIECE
_IN_WORD[list(b" \t")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some texts: their text, distinct number, text and piece, in order."""

    text: pa.Array
    code: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray  # of the distinct words

    def __len__(self) -> int:
        return len(self.code)

    def joined(self, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Runs of words with a space between."""
        ends = np.cumsum(sizes)
        place = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), self.text.take(pa.array(place)))
        return pc.binary_join(lists, " ")


def words_of(texts: pa.Array) -> Words:
    """Texts without nulls, in pieces at punctuation and line ends, A-Z in lower case."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    letters = _LOWER[letters]
    bounds = bounds - bounds[0]
    begins = np.zeros(len(letters) + 1, bool)
    begins[bounds] = True
    inside = _IN_WORD[letters]
    before, behind = np.append(False, inside[:-1]), np.append(inside[1:], False)
    start = np.flatnonzero(inside & (~before | begins[:-1]))
    end = np.flatnonzero(inside & (~behind | begins[1:])) + 1
    piece = np.cumsum(_ENDS_PIECE[letters] | begins[:-1])[start]
    row = np.searchsorted(bounds, start, "right") - 1
    offsets = pa.py_buffer(np.append(0, np.cumsum(end - start)).astype(np.int32))
    text = pa.StringArray.from_buffers(len(start), offsets, pa.py_buffer(letters[inside]))
    coded = text.dictionary_encode()
    hashes = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    return Words(text, coded.indices.to_numpy().astype(np.int64), row, piece, np.array(hashes, np.uint64))


# -- the parse -----------------------------------------------------------------


def chunk_bounds(words: Words, longest: int = LONGEST, trigger: int = TRIGGER):
    """First word, number of words and ``open`` of each chunk: whether its last window opens another one."""
    count, overlap = len(words), longest - 1
    new = np.append(True, words.piece[1:] != words.piece[:-1]) if count else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], count)
    hashed = words.hashes[words.code] if count else np.zeros(0, np.uint64)
    window = np.zeros(max(0, count - overlap), np.uint64)
    for i in range(overlap):
        window = window * _BASE + hashed[i : i + len(window)]
    # a window is followed by a word of its piece, and does not begin it
    follows = words.piece[overlap:] == words.piece[: len(window)]
    cut = np.flatnonzero((mixed(window) % np.uint64(trigger) == 0) & follows & ~new[: len(window)])
    starts = np.sort(np.concatenate([first, cut]))
    opens = ~np.append(new[starts[1:]], True) if count else np.zeros(0, bool)
    ends = np.append(starts[1:], count) + np.where(opens, overlap, 0)
    return starts, ends - starts, opens


def parsed(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The dictionary: ``lang, chunk, open`` and ``n``, how often the parse of all texts has it."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            words = words_of(part.column("text"))
            first, sizes, opens = chunk_bounds(words)
            of = part.column("lang").take(pa.array(words.row[first]))
            columns = [of, words.joined(first, sizes), pa.array(opens)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "open"])

    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"),
    )
    found = rows.mapInArrow(chunks, "lang string, chunk string, open boolean")
    return found.groupBy("lang", "chunk", "open").agg(F.count("*").alias("n"))


# -- counts over the dictionary -------------------------------------------------


@dataclass
class Run:
    """Some chunks of the dictionary: words, and for each word what may begin there."""

    words: Words
    langs: pa.Array  # distinct
    lang: np.ndarray  # of each word, as a place in langs
    weight: np.ndarray  # of each word: its chunk's frequency
    own: np.ndarray  # phrases that begin here belong to this chunk
    pair: np.ndarray  # hash of each word with the next one
    paired: np.ndarray  # whether that is in the same chunk


def _runs(batches: Iterator[pa.RecordBatch], longest: int = LONGEST) -> Iterator[Run]:
    """The dictionary in runs of about RUN_BYTES; a longer chunk is a run of its own."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for part in parts_of(batches, RUN_BYTES, lambda batch: batch.column("chunk")):
        waiting.append(part)
        held += part.nbytes
        if held >= RUN_BYTES:
            yield _run(pa.Table.from_batches(waiting), longest)
            waiting, held = [], 0
    if waiting:
        yield _run(pa.Table.from_batches(waiting), longest)


def _run(chunks: pa.Table, longest: int) -> Run:
    words = words_of(chunks.column("chunk").combine_chunks())
    langs = chunks.column("lang").combine_chunks().dictionary_encode()
    lang = langs.indices.to_numpy()[words.row]
    weight = chunks.column("n").to_numpy()[words.row]
    opens = chunks.column("open").to_numpy()[words.row]
    ends = np.searchsorted(words.row, words.row, "right")
    own = np.arange(len(words)) < ends - np.where(opens, longest - 1, 0)
    names = [xxhash.xxh3_64_intdigest(name) for name in langs.dictionary.to_pylist()]
    hashed = words.hashes[words.code] if len(words) else np.zeros(0, np.uint64)
    pair = mixed((hashed * _BASE + np.append(hashed[1:], np.uint64(0))) ^ np.array(names, np.uint64)[lang])
    paired = np.append(words.row[1:] == words.row[:-1], False)[: len(words)]
    return Run(words, langs.dictionary, lang, weight, own, pair, paired)


def marked_pairs(dictionary: DataFrame, least: int = LEAST, marks: int = MARKS) -> np.ndarray:
    """A bit for each hash of a pair that may occur ``least`` times, as ``marks / 64`` numbers."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            at = np.flatnonzero(run.own & run.paired)
            at = at[np.argsort(run.pair[at])]
            hashes = run.pair[at]
            new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(at)])
            sums = np.add.reduceat(run.weight[at], new) if len(at) else np.zeros(0, np.int64)
            columns = [pa.array(hashes[new].view(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["pair", "n"])

    found = dictionary.mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    slot = found.where(F.col("n") >= least).select(F.pmod("pair", F.lit(marks)).alias("slot"))
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    rows = slot.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(bits).toPandas()
    table = np.zeros(marks // 64, np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def phrase_counts(
    dictionary: DataFrame, least: int = LEAST, longest: int = LONGEST, marks: int = MARKS
) -> DataFrame:
    """``lang, size, phrase, n`` of all words and phrases that occur ``least`` times.

    The row of size 0 is the number of all words of the language.
    """
    table = dictionary.sparkSession.sparkContext.broadcast(marked_pairs(dictionary, least, marks))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for run in _runs(batches):
            slot = (run.pair & np.uint64(marks - 1)).astype(np.int64)
            marked = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
            yield from _counted(run, run.paired & marked, longest)

    found = dictionary.mapInArrow(counts, "lang string, size int, phrase string, n bigint")
    return (
        found.groupBy("lang", "size", "phrase")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least) | (F.col("size") == 0))
    )


def _counted(run: Run, goes_on: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the run's words and phrases; equal ones get equal numbers, word by word."""
    words = run.words
    distinct = len(words.hashes)
    at = np.flatnonzero(run.own)
    if not len(at):
        return
    totals = np.zeros(len(run.langs), np.int64)
    np.add.at(totals, run.lang[at], run.weight[at])
    yield _rows(run.langs, 0, pa.array([""] * len(totals)), totals)
    number = run.lang[at].astype(np.int64)
    for size in range(1, longest + 1):
        if size > 1:
            further = goes_on[at + size - 2]
            at, number = at[further], number[further]
        if not len(at):
            return
        key = number * distinct + words.code[at + size - 1]
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(number, kind="stable")
        sums = np.add.reduceat(run.weight[at][order], np.searchsorted(number[order], np.arange(len(first))))
        head = at[first]
        phrases = words.joined(head, np.full(len(head), size))
        yield _rows(run.langs.take(pa.array(run.lang[head])), size, phrases, sums)


def _rows(langs: pa.Array, size: int, phrases: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(sums), size), pa.int32())
    return pa.RecordBatch.from_arrays([langs, sizes, phrases, pa.array(sums, pa.int64())], ["lang", "size", "phrase", "n"])


# -- collocations ----------------------------------------------------------------

# Exact: up to 38 digits, and the quotient is cut off.
SCORE = """(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)))
           div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"""


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of each phrase by its lowest-scoring cut.

    Equal scores are decided by the shorter first part. A part that very many
    phrases share is one skewed key of a join with a table of unique keys, which
    adaptive execution splits.
    """
    words = counts.where("size = 0").select("lang", F.col("n").alias("all"))
    part = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = (
        counts.where("size > 1")
        .select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    )
    for name, column in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part.withColumnRenamed("part", name).withColumnRenamed("f", column), ["lang", name])
    cuts = cuts.join(words, "lang").withColumnRenamed("all", "n").withColumn("score", F.expr(SCORE))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    found = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(lowest)
    return found.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def closed(phrases: DataFrame) -> DataFrame:
    """The phrases that are not part of a longer one as frequent as they are.

    It is enough to look one word further: a phrase between the two has the same
    frequency.
    """
    longer = phrases.where("size > 2")
    both = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
    inner = longer.select("lang", F.explode(both).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = phrases.join(inner, ["lang", "phrase"], "left")
    return found.where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two to five words.

    ``a``, ``l``, ``r`` are the frequencies of the phrase and of its parts at the
    lowest-scoring cut, ``n`` all words of the language, ``score`` is ``1000 * a * n
    / (l * r)`` cut off. Phrases that a longer one as frequent contains are left
    out. Ties go to the larger ``a``, then to the phrase that is smaller in UTF-8
    bytes. A null text is empty, a null language is ``und``. Repeated rows count as
    often as they stand there. A text of any length is parsed whole; a piece in
    which no window triggers is one chunk. Other columns are ignored; an empty
    table gives no rows.
    """
    dictionary = written(parsed(docs, text, lang), "chunks")
    counts = written(phrase_counts(dictionary, least), "phrases")
    phrases = closed(scored(counts))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
