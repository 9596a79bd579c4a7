from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from fleetvitals.llm import _text, chunk_recipes


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return sorted(((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=repr)


def check(out, rows):
    got = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def many(odd, prose):
    long = prose(40_000, 1)
    return odd + [(10, long), (11, long), (12, long + " x"), (13, "y " + long), (14, prose(9000, 2)), (15, "a" * 200_000), (16, "a" * 200_000), (17, "a" * 200_001), *((20 + i, "copy") for i in range(40))]


def test_against_brute_force(documents, odd, prose):
    rows = many(odd, prose)
    check(chunk_recipes.exact_groups(documents(rows)), rows)


def weak(body):
    return hashlib.md5(body).digest()[:1]


def test_colliding_digests_are_settled_by_text(documents, odd, prose):
    rows = many(odd, prose) + [(100 + i, f"text number {i % 300}") for i in range(600)]
    native = lambda c: F.substring(F.unhex(F.md5(c)), 1, 1)
    check(chunk_recipes.exact_groups(documents(rows), digest=weak, native=native, digest_bytes=1), rows)


def test_chunks_cover_texts_and_resist_shifts(prose):
    text = prose(60_000, 5)
    texts = [text, "some words before " + text, "", "short"]
    out = list(chunk_recipes.Cutter().chunks(_text.texts(pa.array(texts))))
    assert [b"".join(x).decode() for x in out] == texts
    assert all(len(c) <= chunk_recipes.MOST for x in out for c in x)
    assert len(set(out[0]) & set(out[1])) >= len(out[0]) - 3


def test_empty_and_clashing(documents, clashing):
    assert chunk_recipes.exact_groups(documents([])).collect() == []
    assert [(r.doc_id, r.kept) for r in chunk_recipes.exact_groups(clashing([(1, "x")])).collect()] == [(1, True)]
