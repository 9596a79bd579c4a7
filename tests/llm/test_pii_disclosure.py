from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetvitals.llm import pii_disclosure as p
from fleetvitals.llm import queries

from . import brute
from .conftest import SF

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KEEP = {
    "email": lambda s: True,
    "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
    "card": lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: 9 <= len(digits(s)) <= 15,
}


def plain_base(text):
    """(start, kind, end) in code points, straight from the patterns."""
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if KEEP[kind](m.group())]
    return sorted(found)


def named(spans):
    return ",".join(f"{(*p.KINDS, *p.ACTIONS)[k]}:{a}:{b}" for a, k, b in spans)


def plain_terms(texts, near=p.NEAR, support=p.SUPPORT):
    """word -> (disclosure, action), counted over lists of words."""
    total, occurs = 0, Counter()
    windows, mentions, together = defaultdict(set), Counter(), Counter()
    witnesses = defaultdict(set)
    for text in texts:
        text = text or ""
        spans = plain_base(text)
        every = [(m.start(), m.end(), m.group()) for m in brute.WORD.finditer(text.translate(brute.UPPER))]
        total += len(every)
        occurs.update(w for _, _, w in every)
        free = [x for x in every if not any(x[0] < b and a < x[1] for a, _, b in spans)]
        for a, k, b in spans:
            value = text[a:b]
            e = (k, value.translate(brute.UPPER) if k == 0 else value if k == 1 else digits(value))
            lo = sum(x[0] < a for x in free)
            window = tuple(w for _, _, w in free[max(0, lo - near) : sum(x[0] < b for x in free) + near])
            windows[e].add(window)
            mentions[e] += 1
            for w in set(window):
                together[e, w] += 1
                witnesses[e, w].add(window)
    out = {}
    for (e, w), seen in witnesses.items():
        if len(seen) >= support and len(windows[e]) >= support:
            chance = min(1, mentions[e] * 2 * near / total)
            told = math.log2(min(1, together[e, w] / occurs[w]) / chance) / -math.log2(chance) if chance < 1 else 0
            out[w] = max(out.get(w, -9), told)
    return {w: (d, "remove" if d >= p.REMOVE else "generalise") for w, d in out.items() if d >= p.GENERALISE}


def plain_spans(text, terms):
    text = text or ""
    base = plain_base(text)
    more = []
    for m in brute.WORD.finditer(text.translate(brute.UPPER)):
        hit = terms.get(m.group())
        if hit and not any(m.start() < b and a < m.end() for a, _, b in base):
            more.append((m.start(), 4 + (hit[1] == "remove"), m.end()))
    return sorted([*base, *more])


def expected(rows, terms):
    out = []
    for d, text in rows:
        base = plain_base(text)
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        out.append((d, *counts, hashlib.sha256(named(base).encode()).hexdigest(), named(plain_spans(text, terms))))
    return sorted(out, key=str)


def found(df, model, **more):
    return sorted((tuple(r) for r in p.find(df, model, **more).collect()), key=str)


@pytest.fixture(scope="module")
def corpus(prose):
    """One address that a rare surname always goes with, a second name that mostly does, and prose."""
    r = random.Random(4)
    rows = [(i, prose(r.randint(5, 120), seed=i)) for i in range(150)]
    for i in range(8):
        rows.append((200 + i, f"{prose(20, seed=900 + i)} Schroëdinger wrote from Kvist street é, ask J.Doe@{'Mail' if i % 2 else 'mail'}.example.com or call +1 (212) 555-0{100 + i} {prose(20, seed=950 + i)}"))
    rows += [(300 + i, f"{prose(40, seed=70 + i)} Kvist {prose(9, seed=i)}") for i in range(6)]
    copied = f"{prose(10, seed=44)} Zebulon has 62.211.96.247 and 4111 1111 1111 1111 {prose(10, seed=45)}"
    return rows + [(400 + i, copied) for i in range(20)]


def test_terms_and_spans_equal_plain_counts(spark, documents, corpus):
    df = documents(corpus)
    model = p.fit(df)
    want = plain_terms([t for _, t in corpus])
    got = {r.word: (r.disclosure, r.action) for r in model.collect()}
    assert set(got) == set(want) and all(got[w][1] == a and abs(got[w][0] - d) < 1e-9 for w, (d, a) in want.items())
    assert want["schroëdinger"][1] == "remove" and want["kvist"][1] == "generalise"
    assert "zebulon" not in want  # twenty copies are one witness
    assert found(df, model) == expected(corpus, want)
    # a model too large for the tasks is joined, with the same result
    assert found(df, model, most_terms=0) == expected(corpus, want)


def test_clean_text_holds_neither_entities_nor_terms(documents, corpus):
    df = documents(corpus)
    clean = {r.doc_id: r.clean_text for r in p.find(df, p.fit(df), with_text=True).collect()}
    assert not any("Schroëdinger" in t or "@" in t or "555" in t or "Kvist" in t for t in clean.values())
    assert all(x in clean[201] for x in ("[NAME]", "[EMAIL]", "[PHONE]")) and "Zebulon has [IP] and [CARD]" in clean[400]
    assert clean[0] == dict(corpus)[0]


PIECES = ["a", "Z9", "@", ".", "-", "+", "1", "255", "256", "0007", " ", "(", ")", "é", "日", "x@y.zz", "4111111111111111", "+49 30 1234567", "1.2.3.4", "%_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_patterns_equal_the_contract(text):
    raw = text.encode()
    spans = p.base_spans(raw)
    assert [(len(raw[:a].decode()), k, len(raw[:b].decode())) for a, k, b in spans] == plain_base(text)


def test_very_long_texts_take_linear_time():
    for piece in ("1", "a", "@", "1.", "+", "a@", "+1(", "1-", "a.b@", "1 "):
        assert isinstance(p.base_spans((piece * (1_500_000 // len(piece))).encode()), list)


def test_odd_rows_and_clashing_names(documents, clashing, odd):
    rows = [*odd, (7, "me@x.org"), (7, "me@x.org"), (None, "+1 222 333 4444 é 1.2.3.4"), (8, "word " * 300_000 + "a@b.cd")]
    df = clashing(rows).withColumnRenamed("words", "spans").withColumnRenamed("found", "n_email")
    model = p.fit(df)
    assert model.count() == 0
    assert found(df, model) == expected(rows, {})
    assert p.find(df.limit(0), p.fit(df.limit(0))).count() == 0


def test_query_equals_plain_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_pii_disclosure(spark, SF).collect()), key=str)
    assert got == expected(rows, plain_terms([t for _, t in rows]))
