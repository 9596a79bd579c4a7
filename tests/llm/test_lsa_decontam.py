from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from fleetvitals.llm import _text, lsa_decontam, queries
from tests.llm import brute

BENCH = "item_id bigint, text string"


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 25))] for _ in "ab")
        assert lsa_decontam.common_subsequence(a, b) == brute.longest_common(a, b)


@pytest.fixture(scope="module")
def items(prose):
    return [(i, prose(15 + i, 500 + i, 3000)) for i in range(30)]


def found(docs, bench):
    return {r.doc_id: {x["item"] for x in r.found} for r in lsa_decontam.contamination(docs, bench).collect()}


def test_copies_paraphrases_and_clean(spark, documents, items, prose):
    r, rows, want = random.Random(2), [], {}
    for i, text in items:
        body = prose(300, i, 3000).split(" ")
        at = r.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + [text.upper() if i % 3 == 0 else text] + body[at:])))
        want[i] = {str(i)}
        words = text.split(" ")
        for k in r.sample(range(len(words) * 3 // 4), len(words) // 5):  # the answer, at the end, stays
            words[k] = f"other{k}"
        rows.append((100 + i, " ".join(body[:at] + words + body[at:])))
        want[100 + i] = {str(i)}
        rows.append((200 + i, " ".join(body)))
        want[200 + i] = set()
        half = text.split(" ")[: len(text.split(" ")) // 3]
        rows.append((300 + i, " ".join(body[:at] + half + body[at:])))
        want[300 + i] = set()
    got = found(documents(rows), spark.createDataFrame(items, BENCH))
    wrong = [d for d in want if d < 100 and got[d] != want[d]]
    assert not wrong
    assert sum(got[d] == want[d] for d in want if 100 <= d < 200) >= 27
    assert not any(got[d] for d in want if d >= 200)


def test_answers_decide_paraphrases():
    passage, answer = list(range(20)), [16, 17, 18, 19]
    two_thirds = passage[:13]
    assert lsa_decontam._checked(passage, answer, two_thirds) == 0
    assert lsa_decontam._checked(passage, answer, [16, 17, *two_thirds]) == 0.65
    assert lsa_decontam._checked(passage, answer, passage[:16]) == 0.8
    assert lsa_decontam._checked(passage, answer, passage[:9] + answer[:1]) == 0


def test_recall_on_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, bench = ({r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()} for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    grams, size = {}, {}
    for i, t in bench.items():
        w = brute.words(t.lower())
        size[i] = len(w) - 3
        for k in range(len(w) - 3):
            grams.setdefault(tuple(w[k : k + 4]), set()).add(i)
    true = set()
    for d, t in docs.items():
        w, seen = brute.words(t.lower()), {}
        for g in {tuple(w[k : k + 4]) for k in range(len(w) - 3)}:
            for i in grams.get(g, ()):
                seen[i] = seen.get(i, 0) + 1
        if any(n >= 0.6 * size[i] for i, n in seen.items()):
            true.add(d)
    got = {r.doc_id for r in queries.op8_lsa_decontam(spark, folder).where("contaminated").collect()}
    assert len(true) > 100 and len(got & true) >= 0.98 * len(true) and len(got - true) <= 0.02 * len(true)


def test_basis_spans_the_strongest_directions(spark):
    texts = ["red green blue", "red green", "green blue red red", "one two", "two three one", "three two"] * 5
    h = [lsa_decontam._hashes(_text.texts(pa.array([t])), lsa_decontam._hasher())[1] for t in texts]
    vocabulary = np.unique(np.concatenate(h))
    df = spark.createDataFrame([(t,) for t in texts], "_llm_text string").repartition(3)
    idf = np.linspace(1, 2, len(vocabulary))
    a = np.array([np.bincount(lsa_decontam._numbers(x, vocabulary), minlength=len(vocabulary)) * idf for x in h])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    basis = lsa_decontam.latent_basis(df, vocabulary, idf, rank=3)
    _, s, v = np.linalg.svd(a)
    assert np.allclose(np.linalg.norm(a @ basis, axis=0), s[:3])
    assert np.allclose(np.abs(np.sum(basis * v[:3].T, axis=0)), 1)


def test_edges(spark, documents, clashing, odd, items):
    bench = spark.createDataFrame([*items, (None, None), (77, ""), (78, " ... "), (5, items[5][1])], BENCH)
    rows = [*odd, (60, items[7][1]), (60, items[7][1]), (61, "x " * 30_000 + items[9][1])]
    got = lsa_decontam.contamination(documents(rows), bench).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.found[0]["item"]) for r in got if r.found) == [(60, "7"), (60, "7"), (61, "9")]
    kept = lsa_decontam.keep_uncontaminated(documents(rows), bench)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(odd, key=repr)
    assert lsa_decontam.contamination(documents([]), bench).collect() == []
    empty = spark.createDataFrame([], BENCH)
    assert not any(r.found for r in lsa_decontam.contamination(documents(rows), empty).collect())
    extra = clashing([(1, "fine words"), (2, items[3][1])])
    assert [r.asDict() for r in lsa_decontam.keep_uncontaminated(extra, bench).collect()] == [r.asDict() for r in extra.where("doc_id = 1").collect()]


def test_blocks_find_the_same(spark, documents, items, prose, monkeypatch):
    rows = [(i, prose(40, i) + " " + t + " " + prose(40, 90 + i)) for i, t in items]
    bench = spark.createDataFrame(items, BENCH)
    whole = found(documents(rows), bench)
    monkeypatch.setattr(lsa_decontam, "BLOCK_BYTES", 2000)
    assert len(list(lsa_decontam.blocks(bench))) > 1
    assert found(documents(rows), bench) == whole == {i: {str(i)} for i, _ in items}


def test_answer_column_is_used(spark):
    df = spark.createDataFrame([(1, "some question words", "the answer")], "item_id bigint, text string, answer string")
    held = next(lsa_decontam.blocks(df))
    assert len(held.words[0]) == 3 and len(held.answer[0]) == 2 and not set(held.answer[0]) & set(held.words[0])


def test_recall_does_not_depend_on_the_number_of_documents(prose):
    r, hasher = random.Random(4), lsa_decontam._hasher()
    items = [(i, prose(9 + i % 50, 700 + i, 3000), None) for i in range(60)]
    held = lsa_decontam.passages(items)
    rng = np.random.default_rng(4)
    words = rng.standard_normal((len(held.vocabulary), len(held.vocabulary))).astype(np.float32) / 30
    place = {int(x): k for k, x in enumerate(held.vocabulary)}
    for n in (10_000, 100_000_000):
        idf = np.log((1 + n) / (1 + rng.integers(1, n // 20, len(held.vocabulary)))) + 1
        queries = np.stack([words[[place[int(x)] for x in p]].sum(axis=0) for p in held.words])
        index = lsa_decontam.Index(held, idf, words=words, queries=lsa_decontam._unit(queries))
        missed = 0
        for i, text, _ in items:
            own = text.split(" ")
            for k in r.sample(range(len(own) * 3 // 4), len(own) // 5):
                own[k] = f"other{k}"
            host = [f"unknown{r.randint(0, 10**6)}" for _ in range(100)]
            at = r.randint(0, 100)
            found = lsa_decontam.hits(_text.texts(pa.array([" ".join(host[:at] + own + host[at:])])), index, hasher)
            missed += str(i) not in {x[0] for x in found.get(0, [])}
        assert missed <= 1, (n, missed)


def dense(text, index, hasher):
    """Items found when every window is compared with every passage."""
    held, out = index.passages, {}
    h = lsa_decontam._hashes(_text.texts(pa.array([text])), hasher)[1]
    v = lsa_decontam._numbers(h, held.vocabulary)
    for length in lsa_decontam.WINDOWS:
        for start in range(0, len(h), lsa_decontam.STRIDE):
            end = min(start + length, len(h))
            inside = v[start:end][v[start:end] >= 0]
            x = index.words[inside].sum(axis=0)
            cosine = index.queries @ (x / max(np.linalg.norm(x), 1e-12))
            low, high = max(0, start - lsa_decontam.MARGIN), min(len(h), end + lsa_decontam.MARGIN)
            for p in np.flatnonzero(cosine >= lsa_decontam.MIN_COSINE) if len(inside) else ():
                share = lsa_decontam._checked(held.words[p].tolist(), held.answer[p].tolist(), h[low:high].tolist())
                if share:
                    out[held.item[p]] = max(out.get(held.item[p], 0), round(share, 6))
    return out


def test_rare_words_leave_out_nothing_that_a_dense_search_finds(prose):
    r, hasher = random.Random(6), lsa_decontam._hasher()
    items = [(i, prose(r.choice([1, 2, 4, 9, 30, 70, 150]), 300 + i, r.choice([30, 60, 3000])), None) for i in range(60)]
    held = lsa_decontam.passages(items)
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 9, len(held.vocabulary))
    words = (idf[:, None] * rng.standard_normal((len(idf), 24))).astype(np.float32)
    place = {int(x): k for k, x in enumerate(held.vocabulary)}
    queries = np.stack([words[[place[int(x)] for x in p]].sum(axis=0) for p in held.words])
    index = lsa_decontam.Index(held, idf, words, lsa_decontam._unit(queries))
    texts = []
    for i, text, _ in items:
        own = text.split(" ")
        for k in r.sample(range(len(own)), len(own) // 4):
            own[k] = r.choice(own)
        at = r.randrange(len(own) + 1)
        own[at:at] = [f"filler{r.randrange(99)}" for _ in range(r.choice([0, 0, 3, 15]))]
        texts.append(" ".join([prose(r.randint(0, 90), i, 60), *own, prose(r.randint(0, 90), i + 1, 60)]))
    texts += ["", prose(300, 8, 30), *[x for _, x, _ in items[:9]]]
    got = lsa_decontam.hits(_text.texts(pa.array(texts)), index, hasher)
    want = {i: d for i, text in enumerate(texts) if (d := dense(text, index, hasher))}
    assert {i: {x[0] for x in found} for i, found in got.items()} == {i: set(d) for i, d in want.items()}
    assert len(want) > 40


def test_both_products_see_the_same_texts(spark, documents, items, prose, monkeypatch):
    monkeypatch.setattr(lsa_decontam, "SAMPLE_DOCUMENTS", 2)
    seen = []
    product = lsa_decontam._product
    monkeypatch.setattr(lsa_decontam, "_product", lambda texts, *a: seen.append(sorted(r[0] for r in texts.collect())) or product(texts, *a))
    held = next(lsa_decontam.blocks(spark.createDataFrame(items, BENCH)))
    lsa_decontam.build(documents([(i, prose(30, i)) for i in range(40)], 5), held)
    assert len(seen) == 2 and seen[0] == seen[1]


def test_the_basis_is_fitted_on_every_document(spark, documents, items, prose, monkeypatch):
    rows = [(i, prose(20, i % 700) + " " + items[i % 30][1][:40]) for i in range(1500)] + [(1500, None), (1501, "unknown")]
    seen = []
    basis = lsa_decontam.latent_basis
    monkeypatch.setattr(lsa_decontam, "latent_basis", lambda texts, *a: seen.append(texts.count()) or basis(texts, *a))
    held = next(lsa_decontam.blocks(spark.createDataFrame(items, BENCH)))
    lsa_decontam.build(documents(rows, 5), held)
    assert seen == [len(rows) + len(items)]


def test_known_words_of_half_passages(spark):
    own = [lsa_decontam._hashes(_text.texts(pa.array([t])), lsa_decontam._hasher())[1] for t in ("b", "a", "c")]
    vocabulary = np.sort(np.concatenate(own))
    b, a, c = (int(x) for x in lsa_decontam._numbers(np.concatenate(own), vocabulary))
    texts = ["c b x b " + "x " * 28 + "a b " + "x " * 40 + "c", None, "", "x", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "_llm_text string").coalesce(1)
    got = [tuple(r) for r in lsa_decontam.known_words(df, vocabulary).collect()]
    assert got[1:] == [([], []), ([], []), ([], []), ([a], [1])]
    words = lsa_decontam._numbers(lsa_decontam._hashes(_text.texts(pa.array([texts[0]])), lsa_decontam._hasher())[1], vocabulary)
    halves = [sorted(int(v) for v in words[k : k + 32] if v >= 0) for k in range(0, len(words), 32)]
    assert got[0] == ([v for x in halves for v in x], [len(x) for x in halves if x])
    n, df_counts = lsa_decontam.document_counts(lsa_decontam.known_words(df, vocabulary), 3)
    assert n == 5 and (df_counts[a], df_counts[b], df_counts[c]) == (2, 1, 1)
