from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import _text, language_id, queries


@pytest.fixture(scope="module")
def predicted(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op6_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    return out.collect()


def test_held_out_accuracy(predicted):
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in predicted)
    held = [r for r in predicted if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in predicted)


def plain_vector(text):
    """Shares of the grams of each length, byte by byte."""
    t = _text.texts(pa.array([text]))
    out = np.zeros(1 << language_id.BITS)
    for k, bucket in language_id._grams(t):
        own = bucket[: max(0, len(text.encode()) - k + 1)]
        for x in own:
            out[x] += 1 / len(own)
    return out


def test_vectors_do_not_depend_on_what_stands_beside_a_text():
    texts = ["Hello, Wörld", "", "a", "ÉÀ ab\nab", "some longer text of words"]
    for at_once in (2, 100):
        got = np.concatenate([x for _, x in language_id.vectors(_text.texts(pa.array(texts)), at_once)])
        assert np.allclose(got, [plain_vector(x) for x in texts], atol=1e-6)


def plain_decision(model, x):
    """Votes counted machine by machine: the family, then its languages."""
    def winner(machines):
        votes = dict.fromkeys(machines.names, 0.0)
        pairs = [(a, b) for i, a in enumerate(machines.names) for b in machines.names[i + 1 :]]
        margins = {p: float(x @ machines.weights[:, i].astype(float) + machines.bias[i]) for i, p in enumerate(pairs)}
        for (a, b), m in margins.items():
            votes[a] += (m > 0) + 0.5 * np.tanh(m) / len(votes)
            votes[b] += (m <= 0) - 0.5 * np.tanh(m) / len(votes)
        return max(machines.names, key=lambda n: votes[n])

    return winner(model.within[winner(model.families)])


def test_predictions_are_the_votes_of_the_machines(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.fit(docs, "doc_id % 4 <> 2")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.predict(docs, model).collect():
        text = texts[r.doc_id] or ""
        want = plain_decision(model, plain_vector(text)) if any(c.isalpha() for c in text) else "und"
        assert r.lang_pred == want


def coded(documents, prose, codes):
    """Texts of ``codes`` languages, each with letters of its own."""
    rows = [(i, "".join(chr(97 + (ord(c) * (1 + i % codes) + i % codes) % 26) if c.isalpha() else c for c in prose(40, i))) for i in range(6 * codes)]
    return documents(rows).withColumn("lang", F.concat(F.lit("q"), F.lpad((F.col("doc_id") % codes).cast("string"), 3, "0")))


def test_many_codes_stay_few_machines(documents, prose):
    docs = coded(documents, prose, 60)
    model = language_id.fit(docs, "true")
    met = len(model.families.bias) + max(len(m.bias) for m in model.within.values())
    held = len(model.families.bias) + sum(len(m.bias) for m in model.within.values())
    assert sorted(c for names in model.languages.values() for c in names) == sorted({f"q{i:03}" for i in range(60)})
    assert held < 60 * 59 / 2 * 0.6 and met < held and len(model.within) <= 8
    assert language_id.predict(docs, model).where("lang_pred = 'und'").count() == 0


def test_languages_are_bounded(documents, prose, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 5)
    model = language_id.fit(coded(documents, prose, 12), "true")
    assert sum(map(len, model.languages.values())) == 5


def test_copies_are_one_text(documents, prose):
    once = [(i, prose(30, i)) for i in range(8)]
    lang = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")
    a = language_id.fit(documents(once).withColumn("lang", lang), "true")
    b = language_id.fit(documents(once + [once[0]] * 300).withColumn("lang", lang), "true")
    assert np.allclose(a.families.weights, b.families.weights)


def test_machine_separates():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(1, 0.3, (40, 5)), r.normal(-1, 0.3, (40, 5))])
    y = np.repeat([1.0, -1.0], 40)
    w = language_id.support_vectors(x, y)
    assert ((x @ w[:-1] + w[-1]) * y > 0).all()


def test_edges(documents, clashing, odd):
    train = documents([(i, t) for i, t in enumerate(["the cat and the dog", "der hund und die katze", "le chat et le chien", "el gato y el perro"] * 5)])
    train = train.withColumn("lang", F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("doc_id") % 4 + 1).cast("int")))
    model = language_id.fit(train, "true")
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    out = language_id.predict(documents(odd), model).collect()
    assert len(out) == len(odd)
    und = [r for r in out if r.doc_id in (1, 2, 4, 5)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in und)
    assert all(r.lang_pred in ("de", "en", "es", "fr") for r in out if r.doc_id in (3, 6))
    assert language_id.predict(clashing([(1, "the dog")]), model).count() == 1
    assert language_id.predict(documents([]), model).collect() == []
    none = language_id.fit(documents(odd), "true")  # no language is known
    assert {r.lang_pred for r in language_id.predict(documents(odd), none).collect()} == {"und"}
    one = language_id.fit(train.where("lang = 'en'"), "true")
    assert {r.lang_pred for r in language_id.predict(train, one).collect()} == {"en"}
    odd_code = language_id.fit(train.withColumn("lang", F.when(F.col("lang") == "es", "xx").otherwise(F.col("lang"))), "true")
    assert odd_code.languages["xx"] == ["xx"]
