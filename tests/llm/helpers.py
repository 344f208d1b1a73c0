"""Small tables for the operators' tests."""

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=None):
    """A documents table; ``texts`` are texts (numbered from 0) or (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    table = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    found = spark.createDataFrame(table, DOCUMENTS)
    return found if extra is None else found.selectExpr("*", *extra)


def collected(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def prose(seed, words=80):
    """Random words of a small alphabet, reproducible."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(words))


# Texts with every awkward kind: null, empty, blank, short, long, not ASCII, repeated.
AWKWARD = [None, "", " \n\t ", "one", "ä ö ü ß 漢字 🎉", prose(1), prose(1), prose(2, 6000), "x" * 5000]
