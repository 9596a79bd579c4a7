from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    def build(rows, partitions=3):
        full = [(d, t, None, None, None if t is None else len(t)) for d, t in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with extra columns whose names the operators might use themselves."""

    def build(rows):
        from pyspark.sql import functions as F

        names = ("id", "key", "row", "n", "words", "found", "place", "body", "start", "length", "label", "node", "cell", "part", "slot", "url", "page")
        return documents(rows).withColumns({c: F.lit(f"x{c}") for c in names})

    return build


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0, vocabulary=400):
        r = random.Random(seed)
        stems = [a + b for a in ("tor", "mel", "san", "quil", "der", "hos", "vin", "lap", "gru", "fen") for b in ("a", "em", "is", "ol", "und", "ast", "irk", "oon")]
        pool = [r.choice(stems) + r.choice(stems) for _ in range(vocabulary)]
        out = []
        while len(out) < n:
            line = [r.choice(pool) for _ in range(r.randint(4, 12))]
            out += [*line[:-1], line[-1] + "."]
        return " ".join(out[:n])

    return make


#: Rows that every operator must take: nulls, blanks, ties and repeated rows.
ODD = [(1, None), (2, ""), (None, "alpha beta gamma"), (3, "alpha beta gamma"), (3, "alpha beta gamma"), (3, "other text"), (4, " \n\t "), (None, None), (5, "!?. 12 %%%"), (6, "é日本 ÉÀ straße")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
