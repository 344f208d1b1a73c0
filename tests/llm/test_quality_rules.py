import random
import tracemalloc

import pytest

from orderlens.llm import quality_rules
from tests.llm.helpers import AWKWARD, documents, prose

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for space in SPACES:
        text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def brute(text, least):
    """The same measures by trying all pairs of places."""
    text = text or ""
    words = words_of(text)
    n, covered, longest = len(words), set(), 0
    places = {}
    for i, word in enumerate(words):
        places.setdefault(word, []).append(i)
    for i in range(n):
        best = 0
        for j in places[words[i]]:
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            covered.update(range(i, i + best))
            longest = max(longest, best)
    triples = {}
    for i in range(n - 2):
        triples.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p for at in triples.values() if len(at) > 1 for i in at for p in range(i, i + 3)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
        len(repeated), len(covered), longest,
    )


def texts():
    draw = random.Random(9)
    some = [" ".join(draw.choices("ab", k=draw.randint(0, 60))) for _ in range(15)]
    some += [" ".join(draw.choices("abcdefghijklmnop", k=70) * 2) for _ in range(5)]
    line = prose(3, 12)
    some += [f"{line}\n{line}\n\n{line} \n# * | <é>", prose(4, 200), prose(5, 60) + " " + prose(5, 60)]
    return some + AWKWARD


def test_against_all_pairs(spark):
    every = texts()
    docs = documents(spark, every, ["1 AS n_words", "true AS kept"])
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs, min_repeat=4).collect()}
    for i, text in enumerate(every):
        row, expected = found[i], brute(text, 4)
        assert tuple(row)[1:8] == expected
        n, repeated, covered, longest = expected[0], *expected[4:7]
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert row.kept == (not row.base_failed and 100 * covered <= 12 * n and longest <= 50)


def test_plain_prose_stays_and_long_repeats_go(spark):
    repeated = prose(6, 200) + " " + prose(7, 110) + " " + prose(8, 600) + " " + prose(7, 110)
    rows = quality_rules.quality_rules(documents(spark, [prose(5, 300), repeated])).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept, r.longest_repeat) for r in rows] == [(False, True, 0), (False, False, 110)]


def test_null_keys_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, [(None, "a"), (1, "a"), (1, "a")])
    assert quality_rules.quality_rules(docs).count() == 3
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_each_limit_rejects_alone(spark):
    passage, short = prose(7, 60), prose(9, 12)
    one_long = " ".join([passage, prose(6, 2000), passage])  # 120 of 2,120 words: 5.7 %
    many_short = " ".join(f"{short} {prose(20 + i, 60)}" for i in range(10))  # 120 of 720 words: 16.7 %
    found = quality_rules.quality_rules(documents(spark, [one_long, many_short])).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in found] == [(False, False)] * 2
    assert [(r.n_covered_words, r.longest_repeat) for r in found] == [(120, 60), (120, 12)]
    loose = quality_rules.quality_rules(documents(spark, [one_long, many_short]), max_repeat=60, max_covered=17)
    assert [r.kept for r in loose.collect()] == [True, True]


@pytest.mark.parametrize("text", ["a b " * 500_000, prose(3, 300_000)], ids=["periodic", "prose"])
def test_very_long_text(text):
    tracemalloc.start()
    found = quality_rules._measured([text.encode()], 8, 12, 50)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = len(text.split())
    assert found["n_words"][0] == n
    if text.startswith("a b"):
        assert (found["n_covered_words"][0], found["longest_repeat"][0]) == (n, n - 2)
        assert found["base_failed"][0]
    assert peak < 260 * n
