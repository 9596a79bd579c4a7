from __future__ import annotations

import random

import numpy as np
import pytest

from fleetvitals.llm import _graph, _text, count_rtree_join
from tests.llm import brute


def got(df, size=4, percent=85):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in count_rtree_join.ngram_join(df, size, percent).collect()), key=repr)


def near_copies(prose, n, words, rate, seed):
    r = random.Random(seed)
    base = prose(words, seed).split(" ")
    return [" ".join(w if r.random() > rate else f"w{r.randint(0, 10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("percent,size", [(85, 4), (80, 5)])
def test_against_brute_force(documents, odd, prose, percent, size):
    rows, at = [x for x in odd if x[0] is not None], 100
    for seed, (n, words, rate) in enumerate([(25, 60, 0.01), (25, 300, 0.012), (20, 300, 0.02), (15, 12, 0.03), (10, 1500, 0.015), (12, 9, 0.05), (30, 100, 0.018)]):
        for t in near_copies(prose, n, words, rate, seed):
            rows.append((at, t))
            at += 1
    rows += [(at + i, prose(80, 1000 + i)) for i in range(30)]
    random.Random(1).shuffle(rows)
    assert got(documents(rows), size, percent) == sorted(brute.jaccard_components(rows, size, percent), key=repr)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == sorted(brute.jaccard_components([(r.doc_id, r.text) for r in df.collect()]), key=repr)


def test_chain_of_links_and_null_ids(documents):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:k], *(f"x{k}_{i}" for i in range(0)), *words[k:]][3 * k :]) for k in range(12)]
    rows = [(50 - k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "no one else has this text"), (None, "no one else has this text")]
    assert got(documents(rows)) == sorted(brute.jaccard_components(rows), key=repr)


def test_empty_and_clashing(documents, clashing):
    assert got(documents([])) == []
    assert got(clashing([(1, "a b c d e"), (2, "a b c d e")])) == [(1, 2, 1), (2, 2, 1)]


def test_tree_finds_all_that_the_bound_allows():
    r = np.random.default_rng(2)
    points = r.poisson(r.integers(1, 8, (300, 1)), (300, 32))
    tree = count_rtree_join.CountTree(points)
    for q in points[::20]:
        rows, bounds = tree.search(q, 80)
        full = np.minimum(q, points).sum(axis=1)
        want = np.flatnonzero(180 * full >= 80 * (q.sum() + points.sum(axis=1)))
        assert sorted(rows.tolist()) == want.tolist() and all(full[rows] == bounds)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_linked_sets_share_a_cell(percent):
    table, r = count_rtree_join.levels(percent), np.random.default_rng(percent)
    for n in [*range(2, 40), 60, 100, 333, 1000]:
        for _ in range(12):
            a = np.unique(_text.mixed(r.integers(0, 1 << 62, n).astype(np.uint64)))
            for drop in range(0, n, max(1, n // 30)):
                b = np.delete(a, r.choice(len(a), min(drop, len(a) - 1), replace=False))
                add = np.unique(_text.mixed(r.integers(0, 1 << 62, r.integers(0, 2 + n // 20)).astype(np.uint64)))
                b = np.union1d(b, add)
                if np.array_equal(a, b) or not count_rtree_join._linked(a, b, percent):
                    continue
                own, other = ({n: (room, set(names.tolist())) for n, room, names in count_rtree_join.block_keys(x, table)} for x in (a, b))
                shared = [len(own[n][1] & other[n][1]) - own[n][0] - other[n][0] for n in own if n in other]
                assert max(shared) >= 1  # whichever cells the two leave out


def test_cells_are_split_and_still_whole(documents, prose, monkeypatch):
    monkeypatch.setattr(count_rtree_join, "CELL_ROWS", 4)
    rows = [(i, t) for i, t in enumerate(near_copies(prose, 60, 120, 0.02, 9))]
    assert got(documents(rows)) == sorted(brute.jaccard_components(rows), key=repr)


def test_rows_of_a_search_follow_the_members(documents, prose, monkeypatch):
    """Rows dealt for searches in a group of near copies of which some link with no other: about as
    many for each member in a group of twice the size, and not one for each cell of a member."""
    kind, dealt = type(documents([])), []
    repartition = kind.repartition

    def counted(self, *to):
        if "counts" in self.columns:
            dealt.append(self.count())
        return repartition(self, *to)

    monkeypatch.setattr(kind, "repartition", counted)
    each = []
    for n in (60, 120):
        rows = list(enumerate(near_copies(prose, n, 300, 0.006, 9)))
        rows += [(1000 + i, t) for i, t in enumerate(near_copies(prose, n // 10, 300, 0.03, 9))]
        dealt.clear()
        assert got(documents(rows)) == sorted(brute.jaccard_components(rows), key=repr)
        each.append(sum(dealt) / len(rows))
    assert max(each) < 6 and each[1] < 1.5 * each[0] + 1


def test_a_run_has_few_shuffles(spark, documents, prose, monkeypatch):
    """Shuffles in the plans that are written down, with no join small enough to be a broadcast: a
    round reads what it adds, not what earlier rounds did."""
    shuffles = []

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return settle(df)

    settle = count_rtree_join.settle
    monkeypatch.setattr(count_rtree_join, "settle", counted)
    monkeypatch.setattr(count_rtree_join, "PARTNERS", 1)
    rows = list(enumerate(near_copies(prose, 40, 200, 0.018, 5)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = count_rtree_join.ngram_join(documents(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(brute.jaccard_components(rows))
    assert len(shuffles) > 16 and max(shuffles) <= 8, shuffles


def test_new_links_join_known_labels(spark):
    r = random.Random(4)
    edges = [(b"%04d" % r.randrange(300), b"%04d" % r.randrange(300)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    table = lambda rows: spark.createDataFrame(rows, "a binary, b binary")
    said = lambda labels: sorted((bytes(x.node), bytes(x.label)) for x in labels.collect())
    whole = said(_graph.components(table(edges)))
    for cut in (70, len(edges) - 1):
        assert said(_graph.joined(_graph.components(table(edges[:cut])), table(edges[cut:]))) == whole


def test_groups_are_split_on_either_side(documents, prose, monkeypatch):
    monkeypatch.setattr(count_rtree_join, "CELL_ROWS", 3)
    monkeypatch.setattr(count_rtree_join, "PARTNERS", 1)
    rows = list(enumerate(near_copies(prose, 40, 200, 0.018, 5) + near_copies(prose, 40, 40, 0.03, 6)))
    assert got(documents(rows)) == sorted(brute.jaccard_components(rows), key=repr)


def test_one_of_each_group_stays(documents, prose):
    base = prose(200, 3)
    rows = [(5, base), (6, base), (7, base + " more"), (6, base), (9, prose(200, 4)), (9, prose(200, 5)), (10, None), (11, ""), (None, prose(30, 8))]
    out = count_rtree_join.keep_one(documents(rows))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(5, base), (9, prose(200, 4)), (9, prose(200, 5)), (10, None), (11, ""), (None, prose(30, 8))], key=repr)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
