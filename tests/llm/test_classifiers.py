import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import quality_classifier, toxicity
from orderlens.llm.quality_classifier import site_rates
from tests.llm.helpers import AWKWARD, documents, prose

FOLDER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not present")


def held_out(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def accuracy(found, known):
    hits = [found[k] == v for k, v in known.items() if held_out(k) and k in found]
    assert len(hits) > 500
    return sum(hits) / len(hits)


def test_toxicity_of_held_out_labels(spark, corpus):
    docs, labels, known = corpus
    # held-out labels are never looked at: turned around, nothing changes
    turned = labels.withColumn(
        "toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0,
                        1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = toxicity.toxicity(docs, turned).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert accuracy({r.doc_id: r.predicted for r in rows}, {k: r.toxic for k, r in known.items()}) > 0.97


def test_quality_of_held_out_labels(spark, corpus):
    docs, labels, known = corpus
    rows = quality_classifier.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert accuracy({r.doc_id: r.kept for r in rows}, {k: r.quality == 1 for k, r in known.items()}) > 0.97
    kept = quality_classifier.of_good_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if r.kept}


def small(spark):
    """A learnable table: shouting is poor, and the word grubble toxic."""
    texts = []
    for i in range(160):
        text = prose(i, 60)
        text = text.upper() + "!!" if i % 4 == 1 else text
        texts.append(text + " you grubble" if i % 4 == 2 else text)
    docs = documents(spark, texts, ["1.5 AS score", "'x' AS row", "1 AS evidence", "2 AS features"])
    rows = [(i, int(i % 4 != 1), int(i % 4 == 2)) for i in range(160)]
    return docs, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_extra_columns_nulls_and_repeated_rows(spark):
    docs, labels = small(spark)
    odd = documents(spark, [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "x"), (1000, None)],
                    ["1.5 AS score", "'x' AS row", "1 AS evidence", "2 AS features"])
    odd = odd.withColumn("source", F.when(F.col("doc_id") != 1003, F.col("source")))
    every = docs.unionByName(odd)
    noisy = labels.unionByName(spark.createDataFrame(
        [(None, 1, 1), (5, None, None), (2, 1, 1), (99999, 0, 1)], labels.schema))
    for kept in (toxicity.without_toxic(every, noisy), quality_classifier.of_good_quality(every, noisy)):
        assert kept.columns == every.columns
    found = toxicity.toxicity(every, noisy)
    assert found.count() == every.count()
    assert {r.predicted for r in found.where("doc_id % 4 = 2 AND doc_id < 160").collect()} == {1}
    scores = quality_classifier.quality_scores(every, noisy)
    assert scores.count() == every.count() and scores.where("score IS NULL").count() == 0
    shouting = scores.where("doc_id < 160 AND doc_id % 4 = 1")
    assert {r.kept for r in shouting.collect()} == {False}
    same = {r.score for r in toxicity.toxicity(odd, noisy).where("doc_id = 1000").collect()}
    assert len(same) == 1


def test_score_depends_on_the_text_alone(spark):
    docs, labels = small(spark)
    scored = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    other = documents(spark, [(7, "you grubble"), (8, "you grubble")]).withColumn("lang", F.lit("zz"))
    assert len({r.score for r in scored(other).collect()}) == 1


@pytest.mark.parametrize("known", [[], [(1, 1, 1)], [(i, 1, 0) for i in range(160)]])
def test_too_few_labels(spark, known):
    docs, _ = small(spark)
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    rate = sum(t for _, _, t in known) / len(known) if known and not held_out(known[0][0]) else 0.0
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {rate}
    assert quality_classifier.of_good_quality(docs, labels).count() == 160
    empty = docs.limit(0)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert quality_classifier.quality_scores(empty, labels).count() == 0


def test_sites_shrink_toward_their_hosts(spark):
    rows = [("big", "a", 0.2)] * 400 + [("big", "b", 0.9)] * 400 + [("tiny", "a", 0.0)] + [(None, None, 0.5)] * 3
    rates = site_rates(spark.createDataFrame(rows, "host string, path string, good double"), "host", ["path"])
    found = {(r["host"], r["path"]): (r.host_rate, r.path_rate) for r in rates.collect()}
    overall = sum(g for _, _, g in rows) / len(rows)
    assert len(found) == 4
    assert abs(found["big", "a"][1] - 0.2) < 0.02 and abs(found["big", "b"][1] - 0.9) < 0.02
    host, path = found["tiny", "a"]
    assert 0.4 < host < overall and 0 < path < host


def test_unsure_sites_join_by_shuffle_alike(spark):
    docs, labels = small(spark)
    one = quality_classifier.quality_scores(docs, labels).orderBy("doc_id").collect()
    other = quality_classifier.quality_scores(docs, labels, broadcast_sites=0).orderBy("doc_id").collect()
    assert [r.kept for r in one] == [r.kept for r in other]
    assert all(math.isclose(a.score, b.score, rel_tol=1e-9) for a, b in zip(one, other))


def test_plain_words_and_features():
    assert toxicity.plain("Id10t!") == "idiot"
    assert toxicity.plain("(S7up1d),") == "stupid"
    marks = toxicity.Marks({"idiot": 2.0, "grub-": 1.0})
    found = dict(zip(toxicity.FEATURES, toxicity.features_of(b"You id10t GRUBBY! hmmmm 12 ?", marks)))
    assert found["heaviest_word"] == 2.0 and found["near_second_person"] == pytest.approx(2 / 6)
    assert found["obfuscated_lexicon_words"] == 1.0 and found["stretched_density"] == pytest.approx(1 / 6)
    assert not toxicity.features_of(b" \n", marks).any()
    assert not quality_classifier.features_of(b"").any()
    assert np.isfinite(quality_classifier.features_of(b"a")).all()


def plain_strength(groups):
    """``groups``: (documents, sum, rate expected of them)."""
    n = sum(g[0] for g in groups)
    chance = sum(r * (1 - r) for _, _, r in groups) / n
    spread = sum(m * (g / m - r) ** 2 for m, g, r in groups) / n
    within = sum(m * r * (1 - r) for m, _, r in groups) / n
    return max(1.0, within / max(spread - chance, within * 1e-6))


def plain_rates(rows):
    """Per row (host, path, good): the rates of the whole site, and those without the row; sums taken anew for each."""
    def sums(keep):
        found = [g for i, (h, p, g) in enumerate(rows) if keep(i, h, p)]
        return len(found), sum(found)

    hosts, sites = {r[0] for r in rows}, {r[:2] for r in rows}
    n, good = sums(lambda i, h, p: True)
    host_sums = {host: sums(lambda i, h, p: h == host) for host in hosts}
    strong_host = plain_strength([(*host_sums[host], good / n) for host in hosts])
    whole = {host: (g + strong_host * good / n) / (m + strong_host) for host, (m, g) in host_sums.items()}
    site_sums = {site: sums(lambda i, h, p: (h, p) == site) for site in sites}
    strong_path = plain_strength([(*site_sums[site], whole[site[0]]) for site in sites])
    found = []
    for own, (host, path, _) in enumerate(rows):
        for out in (None, own):
            m, g = sums(lambda i, h, p: i != out)
            overall = g / m if m else good / n
            m, g = sums(lambda i, h, p: i != out and h == host)
            of_host = (g + strong_host * overall) / (m + strong_host)
            m, g = sums(lambda i, h, p: i != out and (h, p) == (host, path))
            found.append((of_host, (g + strong_path * of_host) / (m + strong_path)))
    return found[::2], found[1::2]


def test_sites_and_scores_against_plain_sums(spark):
    draw = random.Random(5)
    rows = []
    for i in range(240):
        host = draw.choice(["hot"] * 6 + ["b", "c", None])
        rows.append((i, host, draw.choice(["x", "y", None]), draw.gauss(1.5 if host == "b" else -0.5, 2)))
    rows.append((240, "alone", "x", 3.0))
    for part in (rows, rows[:1]):
        rate = 0.7
        good = [1 / (1 + math.exp(-(e + math.log(rate / (1 - rate))))) for *_, e in part]
        whole, without = plain_rates([(h, p, g) for (_, h, p, _), g in zip(part, good)])
        table = spark.createDataFrame(part, "id int, host string, path string, evidence double")
        measured = table.select(F.struct("id", "host", "path").alias("row"), "evidence")
        expected = quality_classifier._expected(measured, rate, "host", ["path"])
        rates = {(r.host, r.path): r for r in site_rates(expected, "host", ["path"]).collect()}
        sums = quality_classifier.site_sums(expected, "host", ["path"])
        for limit in (0, 100):
            scored = quality_classifier._scored(measured, sums, rate, "host", ["path"], limit)
            scores = {r.row.id: r for r in scored.collect()}
            assert len(scores) == len(part)
            for (i, host, path, evidence), all_of, others in zip(part, whole, without):
                site = rates[host, path]
                assert (site.host_rate, site.path_rate) == pytest.approx(all_of, abs=1e-9)
                assert (scores[i].host_rate, scores[i].path_rate) == pytest.approx(others, abs=1e-9)
                held = min(max(others[1], 1e-4), 1 - 1e-4)
                score = 1 / (1 + math.exp(-(evidence + math.log(held / (1 - held)))))
                assert scores[i].score == pytest.approx(score, abs=1e-9)


def test_quality_features_against_plain_counts():
    def share(part, whole):
        return part / whole if whole else 0.0

    texts = [t for t in AWKWARD if t and t.strip()] + ["A B! a b.\nA B! a b.\n\nC3 #$ U.S? 12", "THE END. THE END. the"]
    for text in texts:
        raw = text.encode()
        words = raw.split()
        n, size = len(words), len(raw)
        signs = [c for c in text if c.isascii()]
        lines = [line for line in raw.split(b"\n") if line.strip()]
        triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
        upper, lower = sum(c.isupper() for c in signs), sum(c.islower() for c in signs)
        expected = {
            "log_words": math.log(1 + n),
            "capitals": upper / max(1, upper + lower),
            "exclamations": math.log(1 + text.count("!") / n),
            "symbols": math.log(1 + sum(text.count(c) for c in "#*$%&|<>") / n),
            "digits": sum(c.isdigit() for c in signs) / size,
            "duplicate_lines": sum(line in lines[:i] for i, line in enumerate(lines)) / len(lines),
            "distinct_words": len(set(words)) / n,
            "repeated_triples": share(sum(t in triples[:i] for i, t in enumerate(triples)), len(triples)),
            "word_length": math.log(1 + size / n),
            "sentence_ends": math.log(1 + sum(text.count(c) for c in ".?!") / n),
            "lines": math.log(1 + text.count("\n") / n),
        }
        if len(triples) > 500:
            del expected["repeated_triples"]
        found = dict(zip(quality_classifier.FEATURES, quality_classifier.features_of(raw)))
        for name, value in expected.items():
            assert found[name] == pytest.approx(value, abs=1e-12), name


def test_lexicon_against_plain_counts(spark):
    draw = random.Random(9)
    vocabulary = [prose(i, 1) for i in range(60)]
    rows = []
    for i in range(200):
        toxic = i % 4 == 0
        words = draw.choices(vocabulary[: 50 if not toxic else 60], k=30)
        rows.append((i, " ".join(words) + (" grubbling" if toxic and i % 3 else ""), float(toxic)))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "key int, text string, label double"))
    counts = {0.0: {}, 1.0: {}}
    for _, text, label in rows:
        plain = {toxicity.plain(w) for w in text.split()} - {""}
        for entry in {w for w in plain} | {f"{w[:k]}-" for w in plain for k in (4, 5, 6) if len(w) >= k}:
            counts[label][entry] = counts[label].get(entry, 0) + 1
    expected = {}
    for entry, n in counts[1.0].items():
        odds = math.log((n + 0.5) / (50 + 1)) - math.log((counts[0.0].get(entry, 0) + 0.5) / (150 + 1))
        if n >= 4 and odds >= 1.5:
            expected[entry] = odds
    assert expected and "grubb-" in expected
    assert found == pytest.approx(expected)


def pooled(rows):
    """Isotonic regression by pooling neighbours that violate the order: (margin, value) of each distinct margin."""
    blocks = []
    for margin in sorted({m for m, _ in rows}):
        labels = [y for m, y in rows if m == margin]
        blocks.append([sum(labels), len(labels), [margin]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, margins = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + margins]
    return {m: total / n for total, n, margins in blocks for m in margins}


def test_calibration_against_pooled_neighbours(spark, monkeypatch):
    seen = []

    class Recorded(toxicity.IsotonicRegression):
        def fit(self, rows, *args):
            model = super().fit(rows, *args)
            seen.append((rows.collect(), model.transform(rows).collect()))
            return model

    monkeypatch.setattr(toxicity, "IsotonicRegression", Recorded)
    docs, labels = small(spark)
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    toxicity.train(docs, turned, "doc_id", "text", "toxic")
    (rows, scores), = seen
    expected = pooled([(r.margin, r.label) for r in rows])
    assert len(rows) > 20 and len(set(expected.values())) > 1
    assert all(r.score == pytest.approx(expected[r.margin], abs=1e-9) for r in scores)
