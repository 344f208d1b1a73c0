"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned too: words and word beginnings that mark toxic documents
of the training fold. The features are densities of lexicon words, how near they
stand to the second person, capitals, punctuation and obfuscation.

Labels are split by the CRC-32 of the key's text modulo ``FOLDS``: remainder
``HELD_OUT`` is never learned from, ``CALIBRATION`` calibrates, and the others
make the lexicon and the trees. At most about ``FIT_ROWS`` labelled documents,
chosen by the hash of their keys, are learned from; all documents are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm.labelled import HELD_OUT, fold, labelled
from orderlens.llm.workspace import column_of, slices, whole_rows, written

CALIBRATION = 1
FIT_ROWS = 12_000
TREES, DEPTH, STEP = 20, 3, 0.3
LEXICON_SIZE, CANDIDATES = 512, 4096
LEAST_DOCUMENTS = 4
BEGINNINGS = (4, 5, 6)
NEAR_WORDS = 5
# Words whose marks a worker remembers.
MEMORY_WORDS = 200_000

SECOND_PERSON = frozenset(
    "you your yours yourself u du dich dir dein deine deinen ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros os".split()
)
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = (
    "log_words", "lexicon_density", "lexicon_weight", "heaviest_word", "log_lexicon_words",
    "second_person_density", "near_second_person", "capitals", "capital_words", "exclamations",
    "questions", "punctuation", "digits", "obfuscated_density", "obfuscated_lexicon_words",
    "stretched_density",
)

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "!", "?", ".,;:'\"()-!?", "0123456789")
_BYTE_CLASSES = np.array([[chr(b) in chars for b in range(256)] for chars in _CLASSES], np.int64)
_OBFUSCATED = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]")
_STRETCHED = re.compile(r"(\w)\1\1")
_LETTERS = re.compile(r"[\W\d_]+")
_EDGES = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    """Lower case, look-alike signs between letters read as letters, other signs dropped."""
    word = _EDGES.sub("", word.lower())
    if _OBFUSCATED.search(word):
        word = word.translate(LOOKALIKES)
    return _LETTERS.sub("", word)


def entries(word: str) -> list[str]:
    """The lexicon entries a plain word may match: itself, and its beginnings marked by a dash."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]


class Marks(dict):
    """For each word as written: the place of its weight in ``weights``, times 16, and four flags.

    The flags are: second person, obfuscated, capitals, stretched.
    """

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.weights = np.array([0.0, *lexicon.values()])
        self.places = {entry: place for place, entry in enumerate(lexicon, 1)}

    def __missing__(self, token: bytes) -> int:
        word = token.decode()
        bare = plain(word)
        found = [self.places[e] for e in entries(bare) if e in self.places] if bare else []
        place = max(found, key=lambda i: self.weights[i], default=0)
        if len(self) > MEMORY_WORDS:
            self.clear()
        self[token] = mark = (
            place << 4
            | (bare in SECOND_PERSON)
            | bool(_OBFUSCATED.search(word)) << 1
            | (len(bare) > 1 and word.isupper()) << 2
            | bool(_STRETCHED.search(word)) << 3
        )
        return mark


def features_of(text: bytes, marks: Marks) -> np.ndarray:
    """The dense features of a text; zero everywhere if it has no words."""
    tokens = text.split()
    found = np.zeros(len(FEATURES))
    if not tokens:
        return found
    flags = np.fromiter(map(marks.__getitem__, tokens), np.int64, len(tokens))
    weight = marks.weights[flags >> 4]
    hits, second = weight > 0, (flags & 1) > 0
    words, hit_count = len(tokens), int(hits.sum())
    close = 0
    if hit_count and second.any():
        places, people = np.flatnonzero(hits), np.flatnonzero(second)
        after = np.searchsorted(people, places)
        ahead = np.abs(people[np.minimum(after, len(people) - 1)] - places)
        behind = np.abs(people[np.maximum(after - 1, 0)] - places)
        close = int((np.minimum(ahead, behind) <= NEAR_WORDS).sum())
    obfuscated = (flags & 2) > 0
    upper, lower, calls, asks, signs, digits = _BYTE_CLASSES @ np.bincount(
        np.frombuffer(text, np.uint8), minlength=256
    )
    size = len(text)
    found[:] = (
        math.log1p(words), hit_count / words, weight.sum() / words, weight.max(), math.log1p(hit_count),
        second.sum() / words, close / words, upper / max(1, upper + lower), ((flags & 4) > 0).mean(),
        calls / size, asks / size, signs / size, digits / size, obfuscated.mean(),
        (obfuscated & hits).sum(), ((flags & 8) > 0).mean(),
    )
    return found


# -- fitting -------------------------------------------------------------------


def _entry_counts(docs: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """``entry, documents``: in how many texts each entry (or each wanted one) occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found: Counter[str] = Counter()
            for text in texts:
                words = {plain(token.decode()) for token in set(text.split())}
                own = {entry for word in words if word for entry in entries(word)}
                found.update(own if wanted is None else own & wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                ["entry", "documents"],
            )

    found = docs.select("text").mapInArrow(counts, "entry string, documents bigint")
    return found.groupBy("entry").agg(F.sum("documents").alias("documents"))


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """The entries with the largest log odds of toxic against other documents, at least 1.5.

    Only the ``CANDIDATES`` entries in most toxic documents that occur in
    ``LEAST_DOCUMENTS`` of them are weighed, after a first cut by the toxic side.
    """
    toxic, other = sample.where("label = 1"), sample.where("label = 0")
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return {}
    common = _entry_counts(toxic).where(F.col("documents") >= LEAST_DOCUMENTS)
    common = common.orderBy(F.desc("documents"), "entry").limit(CANDIDATES).collect()
    in_toxic = {row["entry"]: row["documents"] for row in common}
    in_other = {
        row["entry"]: row["documents"]
        for row in _entry_counts(other, frozenset(in_toxic)).collect()  # CANDIDATES rows at most
    }
    odds = {
        entry: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_other.get(entry, 0) + 0.5) / (n_other + 1))
        for entry, n in in_toxic.items()
    }
    best = sorted((entry for entry in odds if odds[entry] >= 1.5), key=lambda e: (-odds[e], e))
    return {entry: odds[entry] for entry in best[:size]}


def with_features(docs: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """``row`` (all columns of docs) and ``features``."""
    rows = whole_rows(docs)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(lexicon)
        for part, texts in slices(batches, column_of("row", text)):
            found = pa.array([features_of(t, marks) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("row"), found], ["row", "features"])

    schema = T.StructType([*rows.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(measured, schema)


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int = FIT_ROWS
) -> Callable[[DataFrame], DataFrame]:
    """A function that gives ``row, score`` of each document.

    Without labels of both kinds in each fold learned from, every score is the
    rate of toxic labels seen (0 if there are none).
    """
    sample = written(labelled(docs, labels, key, text, label, fit_rows), "labelled")
    lexicon = learn_lexicon(sample.where(F.col("fold") != CALIBRATION))
    vectors = written(
        with_features(sample, "text", lexicon).select(
            "row.label", "row.fold", array_to_vector("features").alias("features")
        ),
        "features",
    )
    calibrating = F.col("fold") == CALIBRATION
    kinds = vectors.agg(
        F.count_distinct(F.when(calibrating, F.col("label"))).alias("calibrating"),
        F.count_distinct(F.when(~calibrating, F.col("label"))).alias("fitting"),
        F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate"),
    ).first()
    if min(kinds["calibrating"], kinds["fitting"]) < 2:
        rate = kinds["rate"]
        return lambda rows: whole_rows(rows).select("row", F.lit(rate).alias("score"))
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7
    ).fit(vectors.where(~calibrating))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    judged = trees.transform(vectors.where(calibrating)).select("label", margin)
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(judged)

    def scored(rows: DataFrame) -> DataFrame:
        measured = with_features(rows, text, lexicon)
        judged = trees.transform(measured.withColumn("features", array_to_vector("features")))
        judged = isotonic.transform(judged.select("row", margin))
        return judged.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))

    return scored


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``key, held_out, score, predicted`` of each row.

    The score depends on the text alone. Null and empty texts are scored like any
    other, with all features zero. A null key is not held out. Rows may repeat;
    an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(key, text)
    scored = train(own, labels, key, text, label, fit_rows)(own)
    row_key = F.col(f"row.{key}")
    return scored.select(
        row_key.alias(key),
        F.coalesce(fold(row_key) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, all columns kept."""
    scored = train(docs, labels, key, text, "toxic")(docs)
    return scored.where("score < 0.5").select("row.*")
