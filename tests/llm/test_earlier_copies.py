import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import anchors, substring_dedup, suffix_dedup
from tests.llm.helpers import AWKWARD, documents, prose


def cut(texts, window, split):
    """Symbols that stay in each (id, text), and how many go, by trying all windows in order."""
    seen, found = {}, {}
    for key, text in sorted(texts, key=lambda row: row[0]):
        symbols = split(text or "")
        gone = [False] * len(symbols)
        for i in range(len(symbols) - window + 1):
            own = tuple(symbols[i : i + window])
            if seen.setdefault(own, (key, i)) != (key, i):
                gone[i : i + window] = [True] * window
        found[key] = (symbols, gone)
    return found


def texts():
    """Passages shared at different lengths, copies near and exact, periodic and awkward texts."""
    draw, shared = random.Random(2), [prose(50 + i, 60) for i in range(5)]
    some = []
    for i in range(40):
        words = prose(200 + i, 40).split()
        passage = draw.choice(shared).split()
        low = draw.randint(0, 30)
        words[20:20] = passage[low : low + draw.randint(5, 60)]
        some.append(" ".join(words))
    near = prose(7, 300).split()
    for _ in range(12):
        near[draw.randrange(300)] = "changed"
        some.append(" ".join(near))
    some += ["na " * 200, "na " * 90 + "batman", some[3], some[3] + " " + some[3]]
    rows = list(enumerate(some + AWKWARD))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot_contents", [1, 10_000])
@pytest.mark.parametrize("window", [20, 6])
def test_words(spark, window, hot_contents):
    rows = texts()
    docs = documents(spark, rows, ["1 AS key", "2 AS starts", "3 AS kept"]).repartition(5)
    found = substring_dedup.remove_repeated_words(docs, window=window, gram=min(8, window), hot_contents=hot_contents)
    found = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in found.collect()}
    for key, (words, gone) in cut(rows, window, str.split).items():
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert found[key] == (len(words), sum(gone), kept)
    assert len(found) == len(rows)


@pytest.mark.parametrize("hot_contents", [1, 10_000])
@pytest.mark.parametrize("window", [100, 37])
def test_bytes(spark, window, hot_contents):
    rows = texts()
    docs = documents(spark, rows, ["1 AS n_bytes"]).repartition(5)
    found = suffix_dedup.remove_repeated_bytes(docs, window=window, hot_contents=hot_contents)
    digest = F.sha2("kept", 256).alias("sha")
    rows_found = found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", digest).collect()
    found = {r.doc_id: tuple(r)[1:] for r in rows_found}
    for key, (own, gone) in cut(rows, window, str.encode).items():
        kept = bytes(b for b, g in zip(own, gone) if not g)
        spans = len([run for run in bytes(gone).split(b"\0") if run])
        assert found[key] == (len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_repeated_rows_and_null_keys(spark):
    text = prose(1, 60)
    docs = documents(spark, [(4, text), (4, text), (None, text), (2, "other " + text)])
    found = substring_dedup.remove_repeated_words(docs).collect()
    assert sorted((r.row.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (2, 0), (4, 60), (4, 60)]
    alone = documents(spark, [(4, text), (4, text)])
    assert {r.n_removed for r in substring_dedup.remove_repeated_words(alone).collect()} == {0}
    assert {r.n_removed for r in suffix_dedup.remove_repeated_bytes(alone).collect()} == {0}


def test_empty_table(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert substring_dedup.remove_repeated_words(docs).count() == 0
    assert suffix_dedup.remove_repeated_bytes(docs).count() == 0


def test_text_kept_has_whole_characters(spark):
    shared = "é" * 120
    docs = documents(spark, [(0, "x" + shared), (1, "ü" + shared + "ü")])
    rows = suffix_dedup.remove_repeated_bytes(docs, window=99, as_text=True).collect()
    kept = {r.row.doc_id: r.kept for r in rows}
    assert kept[0][0] == "x" and set(kept[1]) <= {"ü", "é"}


def test_runs_cover_every_window_and_equal_windows_share_an_anchor():
    draw = np.random.default_rng(3)
    symbols = np.concatenate([draw.integers(0, 4, 300), np.tile([1, 2, 3], 60)])
    symbols = anchors.mixed(np.concatenate([symbols, symbols[40:260]]).astype(np.uint64))
    left = len(symbols) - np.arange(len(symbols))
    start, windows, anchor, _ = anchors.runs(symbols, left, 30, 8)
    of = {}
    for s, n, a in zip(start.tolist(), windows.tolist(), anchor.tolist()):
        for i in range(s, s + n):
            of[i] = a
    assert sorted(of) == list(range(len(symbols) - 29))
    by_window = {}
    for i, a in of.items():
        by_window.setdefault(symbols[i : i + 30].tobytes(), set()).add(a)
    assert all(len(found) == 1 for found in by_window.values())


def test_gram_hashes_depend_on_the_gram_alone():
    symbols = anchors.mixed(np.arange(50, dtype=np.uint64) % np.uint64(7))
    for size in (1, 2, 3, 13, 20, 50, 51):
        found = anchors.gram_hashes(symbols, size)
        grams = [symbols[i : i + size].tobytes() for i in range(len(symbols) - size + 1)]
        assert len(found) == len(grams)
        assert len(set(zip(grams, found.tolist()))) == len(set(grams)) == len(set(found.tolist()))


def test_matching_statistics():
    automaton = substring_dedup.SuffixAutomaton()
    seen = []
    draw = random.Random(8)
    for _ in range(12):
        sequence = draw.choices("ab", k=draw.randint(1, 12))
        expected = []
        for end in range(1, len(sequence) + 1):
            lengths = (n for n in range(end, 0, -1) if any(
                s[i : i + n] == sequence[end - n : end] for s in seen for i in range(len(s) - n + 1)))
            expected.append(next(lengths, 0))
        assert automaton.matching(sequence) == expected
        automaton.add(sequence)
        seen.append(sequence)
