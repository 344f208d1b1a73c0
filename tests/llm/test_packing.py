import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orderlens.llm import packing
from tests.llm.helpers import AWKWARD, documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def pieces(tokenizer, text, capacity):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    for number, start in enumerate(range(0, len(ids), capacity)):
        cut = ids[start : start + capacity]
        yield number, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [2048, 64])
@pytest.mark.parametrize("cell_pieces", [7, 1000])
def test_pieces_and_places(spark, tokenizer, capacity, cell_pieces):
    texts = AWKWARD + [prose(i, 5 + 7 * i) for i in range(40)] + ["It's <|endoftext|> WE'LL a\x1cb İΣ."]
    docs = documents(spark, texts, ["1 AS length", "2 AS cell", "3 AS key"])
    rows = packing.pack_documents(docs, PATH, capacity=capacity, cell_pieces=cell_pieces).toPandas()
    found = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)
    expected = [(i, *p) for i, t in enumerate(texts) for p in pieces(tokenizer, t, capacity)]
    assert sorted(map(tuple, found)) == sorted(expected)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    assert rows.groupby("sequence_id")["length"].sum().max() <= capacity


def test_repeated_rows_null_keys_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    rows = packing.pack_documents(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def lengths(seed, count):
    draw = np.random.default_rng(seed)
    return np.minimum(2048, draw.lognormal(6.3, 0.9, count).astype(int) + 1)


def test_few_sequences():
    sizes = lengths(1, 20_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan = packing.configurations(packing.grouped_sizes(histogram, 2048), 2048)
    assert all(sum(s * n for s, n in c.items()) <= 2048 for _, c in plan)
    trimmed = [(use, packing.without_smallest(c)) for use, c in plan]
    sequence = packing.pack(sizes, trimmed, 2048)
    filled = np.bincount(sequence, weights=sizes)
    assert filled.max() <= 2048 and filled.min() > 0
    assert len(filled) <= 1.005 * np.ceil(sizes.sum() / 2048) + 2


def test_configurations_solve_the_rounded_problem():
    # 30 of 1024 pair up, 20 of 1500 take one of 500 each
    plan = packing.configurations({500: 20, 1024: 30, 1500: 20}, 2048)
    assert sum(use for use, _ in plan) == pytest.approx(35)


def test_groups_have_equal_cardinality():
    sizes = packing.grouped_sizes({n: 10 for n in range(1, 2049)}, 2048, groups=16)
    assert len(sizes) == 16
    assert max(sizes.values()) - min(sizes.values()) <= 10
    assert sum(sizes.values()) == 10 * (2047 - 256)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="lower-case"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [*"aAzZéÉßÿÀÖØ×÷µªº¼²09'’!?.,-_<|>$`^~ \n\t\r\x0b\x0c\x1c\x85\xa0\u3000漢字🎉İΣσ\u0301\u0308ΩЖ\x00\x7f\xad",
       "'s", "'LL", "<|endoftext|>", "Hello", "don't"]


@pytest.mark.parametrize("memory", [packing.MEMORY_TEXTS, 3])
def test_ids_of_many_texts_are_the_tokenizers(tokenizer, monkeypatch, memory):
    monkeypatch.setattr(packing, "MEMORY_TEXTS", memory)
    draw = random.Random(3)
    texts = ["", *("".join(draw.choices(ODD, k=draw.randint(0, 30))) for _ in range(3000)), "x" * 3000, ""]
    known = packing.WordIds(PATH)
    for part in (pa.array(texts), pa.array(["", ""]), pa.array(texts).slice(5, 900)):
        ids, ends = known.of(part)
        found = [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in part.to_pylist()]
    assert max(len(known.tokens), len(known.words)) <= memory


class Asked(packing.Remembered):
    count = 0

    def __getitem__(self, text):
        self.count += 1
        return super().__getitem__(text)


def test_a_repeated_word_is_looked_up_once(tokenizer):
    """Work in Python grows with the different words of the texts, not with the words."""
    known = packing.WordIds(PATH)
    known.tokens, known.words = Asked(known.tokens.find), Asked(known.words.find)
    text = "Red, blue\tred BLUE, don't red,\n3 "
    ids, ends = known.of(pa.array([text * 200] * 5))
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids * 1000
    assert ends.tolist() == [len(ids) // 5 * n for n in range(1, 6)]
    assert known.tokens.count <= len({"red", "blue", ",", ""}) and known.words.count == len({"don't", "3"})
