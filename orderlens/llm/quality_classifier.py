"""Quality classifier by hierarchical empirical Bayes.

A logistic regression over dense text features, fitted on a bounded sample of
labelled documents, gives each document its evidence: the log odds beyond the
base rate. Hosts and paths give the prior: the expected number of good documents
of each path, summed over all documents, is shrunk toward its host's rate and
the host's toward the global rate. How strongly follows from how much the sites
differ beyond chance, so a sparse site says little and a large one much. The
score joins the evidence with the prior of the document's path. A document's own
evidence counts once: its host's, its path's and the global rate are those of
the other documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm.labelled import labelled
from orderlens.llm.workspace import column_of, slices, whole_rows, written

FIT_ROWS = 12_000
REGULARIZATION = 1e-3
KEEP_FROM = 0.5
# Sites up to this many are broadcast (some 10 MB), more are joined by shuffle.
BROADCAST_SITES = 100_000
SMALLEST_RATE = 1e-4

FEATURES = (
    "log_words", "capitals", "capital_words", "exclamations", "symbols", "digits", "duplicate_lines",
    "distinct_words", "repeated_triples", "word_length", "sentence_ends", "lines", "signs", "unlettered",
)

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "!", "#*$%&|<>", "0123456789", ".?!", "\n")
_BYTE_CLASSES = np.array([[chr(b) in chars for b in range(256)] for chars in _CLASSES], np.int64)
_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)], np.int64)


def features_of(text: bytes) -> np.ndarray:
    """The dense features of a text; zero everywhere if it has no words."""
    words = text.split()
    found = np.zeros(len(FEATURES))
    if not words:
        return found
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, calls, symbols, digits, ends, breaks = _BYTE_CLASSES @ counts
    n, size = len(words), len(text)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    triples = len(set(zip(words, words[1:], words[2:])))
    found[:] = (
        np.log1p(n), upper / max(1, upper + lower), sum(w.isupper() and len(w) > 1 for w in words) / n,
        np.log1p(calls / n), np.log1p(symbols / n), digits / size, 1 - len(set(lines)) / len(lines),
        len(set(words)) / n, 1 - triples / max(1, n - 2) if n > 2 else 0.0, np.log1p(size / n),
        np.log1p(ends / n), np.log1p(breaks / n), (_SIGNS @ counts) / size,
        sum(not w.isalpha() and not any(b > 64 for b in w) for w in words) / n,
    )
    return found


def _measured(docs: DataFrame, text: str, result: T.StructField, of: Callable) -> DataFrame:
    """``row`` (all columns of docs) and a column that ``of`` computes from the features."""
    rows = whole_rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, column_of("row", text)):
            values = of(np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([part.column("row"), values], ["row", result.name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, result]))


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int = FIT_ROWS
) -> tuple[Callable[[DataFrame], DataFrame], float]:
    """A function that gives ``row, evidence`` of each document, and the base rate.

    With labels of one kind only the evidence is 0; without any the base rate is 1.
    """
    sample = written(labelled(docs, labels, key, text, label, fit_rows), "labelled")
    vectors = T.StructField("features", T.ArrayType(T.DoubleType()))
    table = written(
        _measured(sample, "text", vectors, lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))).select(
            "row.label", array_to_vector("features").alias("features")
        ),
        "features",
    )
    seen = table.agg(F.count_distinct("label"), F.avg("label")).first()
    weights, rate = np.zeros(len(FEATURES)), 1.0 if seen[1] is None else seen[1]
    rate = min(max(rate, SMALLEST_RATE), 1 - SMALLEST_RATE)
    bias = 0.0
    if seen[0] > 1:
        model = LogisticRegression(regParam=REGULARIZATION, maxIter=50).fit(table)
        weights = model.coefficients.toArray()
        bias = model.intercept - float(np.log(rate / (1 - rate)))
    evidence = T.StructField("evidence", T.DoubleType())
    return lambda rows: _measured(rows, text, evidence, lambda x: pa.array(x @ weights + bias)), rate


# -- sites ---------------------------------------------------------------------


def _odds(rate: Column) -> Column:
    held = F.greatest(F.lit(SMALLEST_RATE), F.least(F.lit(1 - SMALLEST_RATE), rate))
    return F.log(held / (1 - held))


def _strength(rate: Column) -> Column:
    """Pseudo-documents of the prior: large where the sites' rates differ by chance only.

    A method of moments: the spread of the sites' rates around ``rate``, less what
    documents drawn at that rate would show, against the spread within.
    """
    chance = F.sum(rate * (1 - rate)) / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, 2)) / F.sum("n")
    within = F.sum(F.col("n") * rate * (1 - rate)) / F.sum("n")
    beyond = F.greatest(spread - chance, within * 1e-6)
    return F.greatest(F.lit(1.0), within / beyond)


def site_sums(expected: DataFrame, host: str, path: Sequence[str]) -> DataFrame:
    """``host, *path`` and the sums and prior strengths that `_rates` needs, one row a site.

    ``expected`` has one row a document with ``good``, its chance to be good.
    Documents are summed per path map-side first; all later steps are on sites.
    """
    sites = [f"site_{i}" for i in range(1 + len(path))]
    expected = expected.select(host, *path, "good").toDF(*sites, "good")
    paths = expected.groupBy(*sites).agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("site_0").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    every = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    count, good = every["n"] or 0, every["good"] or 0.0
    count = max(1, count)  # without documents there are no sites to rate
    overall = F.lit(good / count)
    prior = hosts.agg(_strength(overall).alias("s")).first()["s"] or 1.0
    hosts = hosts.select(
        F.col("site_0").alias("host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"),
        F.lit(prior).alias("host_prior"), F.lit(count).alias("all_n"), F.lit(good).alias("all_good"),
    )
    paths = paths.join(hosts, F.col("site_0").eqNullSafe(F.col("host"))).drop("host")
    whole_host_rate = _rates(F.lit(0), F.lit(0.0))[0]
    prior = paths.agg(_strength(whole_host_rate).alias("s")).first()["s"] or 1.0
    return paths.withColumn("path_prior", F.lit(prior)).toDF(host, *path, *SUMS)


# The columns of `site_sums` after the site's own.
SUMS = ("n", "good", "host_n", "host_good", "host_prior", "all_n", "all_good", "path_prior")


def _rates(left_out: Column, left_out_good: Column) -> tuple[Column, Column]:
    """The shrunk rates of host and path without so many documents of theirs; the priors' strengths stay."""

    def rest(n: str, good: str) -> tuple[Column, Column]:
        return F.col(n) - left_out, F.greatest(F.lit(0.0), F.col(good) - left_out_good)

    n, good = rest("all_n", "all_good")
    overall = F.when(n > 0, good / n).otherwise(F.col("all_good") / F.col("all_n"))
    n, good = rest("host_n", "host_good")
    host = (good + F.col("host_prior") * overall) / (n + F.col("host_prior"))
    n, good = rest("n", "good")
    return host, (good + F.col("path_prior") * host) / (n + F.col("path_prior"))


def site_rates(expected: DataFrame, host: str, path: Sequence[str]) -> DataFrame:
    """``host, *path, host_rate, path_rate`` from one row a document with ``good``, its chance to be good."""
    of_host, of_path = _rates(F.lit(0), F.lit(0.0))
    sites = [f"site_{i}" for i in range(1 + len(path))]
    sums = site_sums(expected, host, path).toDF(*sites, *SUMS)
    return sums.select(*sites, of_host, of_path).toDF(host, *path, "host_rate", "path_rate")


def _scored(
    measured: DataFrame, sums: DataFrame, rate: float, host: str, path: Sequence[str], broadcast_sites: int
) -> DataFrame:
    """``row, evidence, host_rate, path_rate, score``, both rates without the document itself."""
    names = [f"site_{i}" for i in range(1 + len(path))]
    sums = written(sums, "sites").toDF(*names, *SUMS)
    if sums.count() <= broadcast_sites:
        sums = F.broadcast(sums)
    columns = zip([host, *path], names)
    same = reduce(Column.__and__, (F.col(f"row.{c}").eqNullSafe(F.col(s)) for c, s in columns))
    of_host, of_path = _rates(F.lit(1), _chance(rate))
    rated = measured.join(sums, same).select("row", "evidence", of_host.alias("host_rate"), of_path.alias("path_rate"))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate")))))
    return rated.withColumn("score", score)


def _chance(rate: float) -> Column:
    """The chance to be good by the evidence and the base rate alone."""
    return 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(rate / (1 - rate))))))


def _expected(measured: DataFrame, rate: float, host: str, path: Sequence[str]) -> DataFrame:
    return measured.select(f"row.{host}", *[f"row.{c}" for c in path], _chance(rate).alias("good"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: Sequence[str] = ("lang",),
    label: str = "quality",
    fit_rows: int = FIT_ROWS,
    broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """``key, evidence, host_rate, path_rate, score, kept`` of each row.

    ``kept`` is a score of ``KEEP_FROM`` or more; the rates are those of the other
    documents, so documents of one site differ in them. Null and empty texts have all
    features zero; a null host or path is a site like any other. Rows may repeat;
    an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(key, text, host, *path)
    evidence, rate = train(own, labels, key, text, label, fit_rows)
    found = evidence(own).select(F.struct(*[f"row.{c}" for c in (key, host, *path)]).alias("row"), "evidence")
    found = written(found, "evidence")
    sums = site_sums(_expected(found, rate, host, path), host, path)
    scored = _scored(found, sums, rate, host, path, broadcast_sites)
    return scored.select(
        F.col(f"row.{key}").alias(key), "evidence", "host_rate", "path_rate", "score",
        (F.col("score") >= KEEP_FROM).alias("kept"),
    )


def of_good_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: Sequence[str] = ("lang",),
    broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """The rows of ``docs`` with a score of ``KEEP_FROM`` or more, all columns kept.

    The texts are measured twice, once for the sites and once for the verdict, as
    that costs less than a shuffle of all texts.
    """
    evidence, rate = train(docs, labels, key, text, "quality")
    sums = site_sums(_expected(evidence(docs), rate, host, path), host, path)
    scored = _scored(evidence(docs), sums, rate, host, path, broadcast_sites)
    return scored.where(F.col("score") >= KEEP_FROM).select("row.*")
