from __future__ import annotations

from fleetvitals.llm import license_rules, license_scan
from tests.llm import brute

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(rows):
    out = []
    for d, t in rows:
        w = brute.words(t)
        places = [(i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        out.append((d, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def got(df):
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    return [tuple(r[c] for c in cols) for r in license_scan.summary(license_scan.license_scan(df)).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_base_places_and_words(spark, documents, odd, prose):
    rows = odd + [
        (10, "The MIT  License; mit-license, (MIT) license\nmit. licenses"),
        (11, "GNU General Public License and Apache\tLicense, version 2.0. apache license"),
        (12, prose(3000) + " general\npublic\nlicense " + prose(50)),
        (13, "mit"), (14, "license"), (15, "mıt license émit license mit éicense"),
    ]
    assert ordered(got(documents(rows))) == ordered(plain(rows))


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ordered(got(df)) == ordered(plain([(r.doc_id, r.text) for r in df.collect()]))


def test_suppression_and_score(documents):
    rows = [(1, "Under the GNU Lesser General Public License, version 2.1, or the BSD 3-clause license"), (2, "plain text")]
    found = {r.doc_id: r for r in license_scan.summary(license_scan.license_scan(documents(rows))).collect()}
    assert found[1].labels == "bsd-3-clause,gpl,lgpl-2.1"  # the base label stays, lgpl without a version goes
    assert found[1].base_labels == "gpl"
    assert 0 < found[1].score <= 1 and found[2].score == 0 and found[2].labels == ""
    kept = {(d.label, d.kept) for d in found[1].detections}
    assert ("lgpl", False) in kept and ("lgpl-2.1", True) in kept


def test_resolved_against_pairs():
    import random

    r = random.Random(1)
    for _ in range(200):
        found = list({("abc"[r.randint(0, 2)], r.randint(1, 3), r.randint(0, 8), r.randint(1, 6), False) for _ in range(12)})
        ranked, taken = sorted(found, key=lambda d: (-d[1], -d[3], d[2], d[0])), []
        for d in ranked:
            if not any(t[2] <= d[2] and d[2] + d[3] <= t[2] + t[3] for t in taken):
                taken.append(d)
        assert {d[:5] for d in license_scan.resolved(found) if d[5]} == set(taken)


def test_rules_are_many_and_hold_their_keyword():
    table = license_rules.rules()
    assert len(table) >= 200
    assert all(r.keyword.decode() in r.pattern.pattern.decode() for r in table if b"(" not in r.pattern.pattern[20:-8])


def test_empty_and_clashing(documents, clashing):
    assert got(documents([])) == []
    assert got(clashing([(1, "mit license")])) == [(1, 2, 1, 0, 0, "mit")]
