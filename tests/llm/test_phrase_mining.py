import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import phrase_mining as mining
from orderlens.llm import queries
from tests.llm.helpers import AWKWARD, documents

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(CAPITALS)):
        yield [w for w in re.split("[ \t]", piece) if w]


def frequencies(rows):
    counts = Counter()
    for text, lang in rows:
        for words in pieces(text):
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[i : i + size])] += 1
    return counts


def expected(rows, least, top=2000):
    counts = frequencies(rows)
    n = Counter()
    for (lang, phrase), f in counts.items():
        n[lang] += f if len(phrase) == 1 else 0
    candidates = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    found = []
    for (lang, p), a in candidates.items():
        inside = any(
            other == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (other, q), f in candidates.items()
        )
        if not inside:
            cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            found.append((lang, -score, -a, " ".join(p).encode(), l, r))
    result, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return result


def texts(seed, count=150):
    """Few words, set phrases, all separators, repeated passages."""
    draw = random.Random(seed)
    phrases = ["New York City", "as soon as possible", "ä ö ü ß 漢", "a a a a a a a"]
    passage = " ".join(draw.choices("abcdefgh", k=60))
    for _ in range(count):
        parts = []
        for _ in range(draw.randint(0, 25)):
            parts.append(draw.choice([*"abcdef", *phrases, passage, "X1"]))
            parts.append(draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!? "]))
        yield "".join(parts)


@pytest.mark.parametrize("seed, least", [(1, 10), (2, 40)])
def test_against_plain_counting(spark, seed, least):
    rows = [(t, draw) for t, draw in zip([*texts(seed), *AWKWARD], ["en", "de", None, "und"] * 50)]
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, chunk string")
    found = mining.collocations(docs.repartition(5), least=least)
    assert sorted(map(tuple, found.collect())) == sorted(expected(rows, least))
    few = mining.collocations(docs, least=least, top=3)
    assert sorted(map(tuple, few.collect())) == sorted(expected(rows, least, 3))


@pytest.mark.parametrize("marks", [64, 1 << 10])
def test_full_tables_of_marks_change_nothing(spark, marks):
    rows = [(t, "en") for t in texts(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    counts = mining.phrase_counts(mining.parsed(docs).cache(), least=20, marks=marks)
    found = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in counts.where("size > 0").collect()}
    assert found == {k: f for k, f in frequencies(rows).items() if f >= 20}


@pytest.mark.parametrize("trigger", [1, 2, 16])
def test_each_phrase_begins_in_one_chunk(trigger):
    """The chunks' own phrases, by frequency, are those of the text, whatever the windows cut."""
    sample = [*texts(5, 40), "a " * 300, "", "...", "one"]
    words = mining.words_of(pa.array(sample))
    first, sizes, opens = mining.chunk_bounds(words, trigger=trigger)
    found = Counter()
    for chunk, is_open in zip(words.joined(first, sizes).to_pylist(), opens):
        parts = chunk.split(" ")
        own = len(parts) - 4 if is_open else len(parts)
        for i in range(own):
            for size in range(1, min(5, len(parts) - i) + 1):
                found[("en", tuple(parts[i : i + size]))] += 1
    assert found == frequencies([(t, "en") for t in sample])
    if trigger < 16:
        assert opens.any()


def test_equal_passages_give_equal_chunks():
    """Beyond the first trigger, a passage is cut alike whatever stands before it."""
    passage = " ".join(random.Random(1).choices("abcdefghijklmnop", k=400))
    cut = []
    for before in ("", "x y z "):
        words = mining.words_of(pa.array([before + passage]))
        first, sizes, _ = mining.chunk_bounds(words)
        cut.append(words.joined(first, sizes).to_pylist()[1:])
    assert len(cut[0]) > 5 and cut[0] == cut[1]


def test_products_beyond_64_bits_are_exact(spark):
    big = 3 * 10**12 + 7
    rows = [("en", 0, "", 9 * 10**18), ("en", 1, "a", big + 1), ("en", 1, "b", big + 5), ("en", 2, "a b", big)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")
    (row,) = mining.scored(counts).collect()
    assert row.score == 1000 * big * 9 * 10**18 // ((big + 1) * (big + 5))


def test_ties_go_to_the_shorter_first_part(spark):
    rows = [("en", 0, "", 100), ("en", 1, "a", 9), ("en", 1, "c", 8), ("en", 2, "a b", 8), ("en", 2, "b c", 9)]
    rows += [("en", 1, "b", 10), ("en", 3, "a b c", 4)]
    # 1000 * 4 * 100 // (9 * 9) = 4938, (8 * 8): 6250
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")
    found = {r.phrase: (r.l, r.r, r.score) for r in mining.scored(counts).collect()}
    assert found["a b c"] == (9, 9, 4938)


def test_empty_tables_and_long_texts(spark):
    assert mining.collocations(documents(spark, ["x"]).limit(0)).collect() == []
    long = documents(spark, ["a b " * 300_000, None, ""])
    found = [tuple(r) for r in mining.collocations(long).collect()]
    assert found == expected([("a b " * 300_000, "en")], 100)


def test_words_at_the_borders_of_texts():
    words = mining.words_of(pa.array(["a", "b c", "", "d.E", " f\t"]).slice(1))
    assert words.text.to_pylist() == ["b", "c", "d", "e", "f"]
    assert words.row.tolist() == [0, 0, 2, 2, 3]
    assert np.diff(words.piece).tolist()[0] == 0 and (np.diff(words.piece)[1:] > 0).all()


def test_query_against_sql(spark, tmp_path):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t)) for i, t in enumerate(texts(7, 900))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_phrase_mining(spark, str(tmp_path))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = base.sql(queries.ORACLES["op11_phrase_mining"]).project(", ".join(found.columns)).fetchall()
    assert len(sql) > 50 and sorted(map(tuple, found.collect())) == sorted(sql)
