import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orderlens.llm import window_packing as packing
from tests.llm.helpers import AWKWARD, documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, capacity):
    """Every id lies in one piece, checksums and places are right, sequences need no padding."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = rows.sort_values(["doc_id", "start"])
    for doc, own in rows.groupby("doc_id"):
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        assert own["length"].sum() == len(ids[doc]) and set(own["doc_tokens"]) == {len(ids[doc])}
        for piece in own.itertuples():
            cut = np.array(ids[doc][piece.start : piece.start + piece.length], "<u4")
            assert piece.ids_crc32 == zlib.crc32(cut.tobytes())
    assert rows["doc_id"].nunique() == len(texts)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    filled = rows.groupby("sequence_id")["length"].sum()
    assert filled.max() <= capacity
    assert all(n & (n - 1) == 0 for n in filled)


@pytest.mark.parametrize("capacity, step", [(2048, 16), (64, 4)])
def test_pieces_and_places(spark, tokenizer, monkeypatch, capacity, step):
    monkeypatch.setattr(packing, "RUN_ROWS", 17)
    odd = ["It's <|endoftext|> WE'LL a\x1cb", "a  b \n c ", " lead", "two 　 wide  x", "\n\n"]
    texts = AWKWARD + [prose(i, 5 + 7 * i) for i in range(40)] + odd
    docs = documents(spark, texts, ["1 AS length", "2 AS ids", "3 AS key", "4 AS tokens"])
    rows = packing.pack_windows(docs.repartition(2), PATH, capacity=capacity, step=step).toPandas()
    check(rows, texts, tokenizer, capacity)


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = packing.pack_windows(documents(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), PATH).collect()
    by_key = sorted((r.doc_id or 0, r.length) for r in rows)
    assert sum(n for _, n in by_key) == 3 + 3 + 2 + 1
    assert {k: sum(n for d, n in by_key if d == k) for k in (0, 1, 2)} == {0: 2, 1: 6, 2: 1}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_windows(documents(spark, ["x"]).limit(0), PATH).count() == 0


def test_a_very_long_text(spark, tokenizer):
    text = prose(3, 400_000) + "y" * 200_000
    rows = packing.pack_windows(documents(spark, [text, "short"]), PATH).toPandas()
    check(rows, [text, "short"], tokenizer, 2048)


def test_ids_are_the_tokenizers(tokenizer):
    draw = random.Random(4)
    letters = [*" \n\t\r\x0b\x1c\x85  ​'sStTl.,!?09aéḿ漢🎉", "  ", "<|endoftext|>"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(5000)]
    ids, ends = packing.ByteLevelIds(PATH).of(pa.array(texts))
    for text, found in zip(texts, np.split(ids, ends[:-1])):
        assert found.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        packing.ByteLevelIds(public_tokenizers.path("word_bpe_49k.json"))


def test_combinations_are_all_partitions():
    found = {tuple(x for x in row if x) for row in packing.combinations(12, 4).tolist()}
    ways = itertools.chain.from_iterable(
        itertools.combinations_with_replacement(range(1, 13), n) for n in range(1, 5)
    )
    assert found == {way for way in ways if sum(way) == 12}
    assert len(packing.combinations(12, 4)) == len(found)


@pytest.mark.parametrize("seed", range(6))
def test_repeats_are_the_least_squares(seed):
    """The conditions of Karush, Kuhn and Tucker hold: no column can be used more or less to gain."""
    draw = np.random.default_rng(seed)
    columns = packing.combinations(24, 3)
    demand = draw.integers(0, 50, 25).astype(float) * (draw.random(25) < 0.7)
    demand[0] = 0
    used = packing.repeats(columns, demand)
    matrix = np.zeros((25, len(columns)))
    for j, column in enumerate(columns):
        np.add.at(matrix[:, j], column, 1.0)
    matrix[0] = 0
    gain = matrix.T @ (demand - matrix @ used)
    assert used.min() >= 0 and gain.max() < 1e-5
    assert np.abs(gain[used > 1e-9]).max(initial=0) < 1e-5


def test_an_exact_cover_is_found():
    # 30 pairs of half windows, 20 of a quarter and three quarters, and 7 of three parts
    histogram = {1024: 60, 512: 20 + 7, 1536: 20, 768: 14}
    plan = packing.planned(histogram)
    total = sum(histogram.values())
    made = {}
    for share, combination in plan:
        for size, n in combination.items():
            made[16 * size] = made.get(16 * size, 0) + n * share * total
    assert made == pytest.approx(histogram, rel=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_most_documents_stay_whole(seed):
    draw = np.random.default_rng(seed)
    rests = np.clip(draw.lognormal(5.9, 0.8, 8000).astype(int), 1, 2047)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rests, return_counts=True))))
    sequences = packing.placed(rests, np.zeros(len(rests), int), packing.planned(histogram))
    filled = [sum(n for _, _, n in s) for s in sequences]
    assert all(n & (n - 1) == 0 for n in filled) and sum(filled) == rests.sum()
    assert sum(n < 2048 for n in filled) <= 11
    held = np.zeros(len(rests), int)
    for document, _, length in itertools.chain.from_iterable(sequences):
        held[document] += length
    assert (held == rests).all()
    cut = len({d for s in sequences for d, start, n in s if n < rests[d]})
    assert cut <= 0.1 * len(rests)


def test_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 5)
    monkeypatch.setattr(packing, "RUN_TOKENS", 100)
    tokens = [10, 10, 500, 1, 1, 1, 1, 1, 1, 99, 2, 100, 1]
    batches = [pa.record_batch({"tokens": pa.array(part, pa.int64())}) for part in (tokens[:4], tokens[4:], [])]
    runs = [run.column("tokens").to_pylist() for run in packing._runs(iter(batches))]
    assert sum(runs, []) == tokens
    assert all(len(run) <= 5 and (sum(run) <= 100 or len(run) == 1) for run in runs)
