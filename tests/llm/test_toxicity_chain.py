from __future__ import annotations

import random

import numpy as np
import pytest

from fleetvitals.llm import queries, toxicity_chain

CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def data(spark, documents, prose):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        text, toxic = prose(r.randint(20, 120), i), i % 4 == 0
        if toxic:
            parts = text.split(" ")
            for w in r.sample(["vilea", "vileb", "vilec"], 2):
                parts.insert(r.randint(0, len(parts)), w)
            text = " ".join(parts)
        rows.append((i, text))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not toxic), int(toxic)))
    labels += [(None, 1, 1), (1, None, 0), (9999, 1, 1), labels[0], labels[0]]
    return documents(rows), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def model(data):
    return toxicity_chain.fit(*data, CATEGORIES)


def test_held_out_documents(data, model):
    labelled = {r.doc_id for r in data[1].collect()}
    out = [r for r in toxicity_chain.probabilities(data[0], model).collect() if r.doc_id not in labelled]
    assert out and all((r.p_toxic >= 0.5) == (r.doc_id % 4 == 0) for r in out)


def test_later_models_take_earlier_probabilities(model):
    assert [len(w) for w in model.weights] == [len(model.weights[0]), len(model.weights[0]) + 1]


def test_out_of_fold_probabilities_train_the_chain():
    r = np.random.default_rng(5)
    x, fold = r.standard_normal((100, 3)), np.arange(100) % 5
    a, b = (x[:, 0] > 0).astype(float), (x[:, 1] + r.standard_normal(100) > 0).astype(float)
    _, weights, biases = toxicity_chain.fit_chain(x, [("a", a), ("b", b)], fold)
    out = np.zeros(100)
    for f in range(5):
        w, c = toxicity_chain._logistic(x[fold != f], a[fold != f])
        out[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w + c)))
    w, c = toxicity_chain._logistic(np.column_stack([x, out]), b)
    assert np.allclose(weights[1], w) and np.isclose(biases[1], c)


def test_same_model_for_any_partitioning(data, model):
    again = toxicity_chain.fit(data[0].repartition(7), data[1].repartition(5), CATEGORIES)
    assert np.array_equal(again.words, model.words) and all(map(np.allclose, again.weights, model.weights))


def test_keeping_clean_rows(documents, clashing, odd, model):
    rows = odd + [(50, "vilea vileb some words"), (50, "VILEB, vilec!")]
    out = toxicity_chain.keep_clean(documents(rows), model, "toxic")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(odd, key=repr)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    extra = clashing([(1, "fine words"), (2, "vilea vileb vilec")])
    assert [r.asDict() for r in toxicity_chain.keep_clean(extra, model, "toxic").collect()] == [r.asDict() for r in extra.where("doc_id = 1").collect()]
    assert toxicity_chain.keep_clean(documents([]), model, "toxic").collect() == []


def test_no_labels_or_one_class(spark, data, documents):
    none = toxicity_chain.fit(data[0], spark.createDataFrame([], LABELS), CATEGORIES)
    assert {round(r.p_toxic, 6) for r in toxicity_chain.probabilities(data[0], none).collect()} == {0.0}
    one = toxicity_chain.fit(data[0], spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS), CATEGORIES)
    assert max(r.p_toxic for r in toxicity_chain.probabilities(data[0], one).collect()) < 1e-6
    empty = toxicity_chain.fit(documents([]), data[1], CATEGORIES)
    assert toxicity_chain.probabilities(documents([]), empty).collect() == []


def test_given_documents(spark):
    import re

    folder = "/root/testdata/sf0.1"
    out = queries.op7_toxicity_chain(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").where("lang = 'en'").collect()
    insult = re.compile(r"\b(idiot|moron|scum|clown|pathetic|worthless|loser|trash|stupid|disgusting)\b", re.I)
    hit = [r.toxic for r in out if len(insult.findall(r.text)) >= 3]
    clean = [r.toxic for r in out if not insult.search(r.text)]
    assert np.mean(hit) > 0.95 and np.mean(clean) < 0.01
