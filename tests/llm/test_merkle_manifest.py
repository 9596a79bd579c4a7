from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import merkle_manifest as m
from fleetvitals.llm import queries
from tests.parity import connect, differences

from .conftest import DOCUMENTS, SF

FIELDS = queries.LEAF


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(top, path of every node) by building the levels one after the other."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, at):
            first = p // 8 * 8
            path.append((nodes[first:p], nodes[p + 1 : first + 8]))
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def plain(rows, changed):
    """rows (doc_id, source, lang, n_chars, text); a sorted list of what the manifest says of each."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = []
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        subs.append(tree([plain_leaf(r) for r in groups[lang]]))
    root, above = tree([top for top, _ in subs]) if subs else (None, [])
    out = []
    for lang, (top, paths), up in zip(order, subs, above):
        for row, path in zip(groups[lang], paths):
            node = plain_leaf(changed(row))
            for left, right in path + up:
                node = h("".join(left) + node + "".join(right))
            proof = h("".join("".join(a) + "".join(b) for a, b in path + up))
            out.append((row[0], plain_leaf(row), top, root, proof, node, node == root))
    return sorted(out, key=str)


def lowered(row):
    if row[0] is None or row[4] is None or zlib.crc32(str(row[0]).encode()) % 3:
        return row
    return (*row[:4], row[4].translate(str.maketrans(queries.CAPITALS, queries.SMALL)))


def found(df):
    low = F.translate("text", queries.CAPITALS, queries.SMALL)
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, m.leaf([low if c == "text" else F.col(c) for c in FIELDS]))
    out = m.manifest(df, "doc_id", "lang", FIELDS, claim).withColumn("proof", m.proof_digest(F.col("path")))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=str)


def some(n, langs=("en", "de", None), seed=3):
    r = random.Random(seed)
    return [(r.randrange(n * 2), r.choice(["web", None]), r.choice(langs), i, r.choice(["Ab C", "", None, "é日本 Ü", "plain"])) for i in range(n)]


def test_equals_the_levels_built_one_by_one(spark):
    rows = [*some(300), (5, "web", "one", 1, "Alone"), (7, None, "", 0, "")]
    df = spark.createDataFrame(rows, DOCUMENTS.replace("lang string, source string, n_chars bigint", "x string").replace("doc_id bigint, text string, x string", "doc_id bigint, source string, lang string, n_chars bigint, text string")).repartition(3)
    assert found(df) == plain(rows, lowered)


@pytest.mark.parametrize("rows", [0, 8, 65, 200])
def test_groups_of_any_size_over_several_passes(spark, monkeypatch, rows):
    monkeypatch.setattr(m, "DEPTH", 1)  # a block is one run, so that 200 rows take three passes
    data = [(i, "s", "en", i, f"Text {i}") for i in range(rows)] + [(i, "s", f"l{i}", i, "X") for i in range(min(rows, 20))]
    df = spark.createDataFrame(data, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(df) == plain(data, lowered)


def test_odd_rows_ties_and_clashing_names(spark, documents, odd):
    rows = [*odd, (3, "long " * 200_000)]
    df = documents(rows).withColumns({c: F.lit("x") for c in ("_rank", "_group", "digest", "item", "path", "leaf", "root", "facts", "kids", "_n")})
    want = plain([(d, None, None, None if t is None else len(t), t) for d, t in rows], lowered)
    assert found(df) == want


def test_a_changed_row_is_the_only_one_that_fails(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    claim = F.when(F.col("doc_id") == 42, F.sha2(F.lit("forged"), 256))
    out = m.manifest(df, "doc_id", "lang", FIELDS, claim).where(~F.col("verified")).collect()
    assert [r.doc_id for r in out] == [42]


def test_the_plan_has_no_join_between_leaves_and_blocks(spark):
    nodes = spark.range(100).select(F.lit("g").alias("_group"), F.col("id").alias("_rank"), F.lit(100).cast("bigint").alias("_n"), F.col("id").cast("string").alias("digest"), F.lit(1).alias("item"))
    done = m.passes(nodes)
    empty = F.array().cast(f"array<{m._STEP}>")
    above = done[-1].select("_group", "_block", empty.alias("path"), F.struct("digest").alias("facts"))
    plan = m.unfold(done, above)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") >= 1


def test_query_equals_its_sql(spark):
    con = connect(SF)
    assert differences(queries.op12_merkle_manifest(spark, SF), con, queries.ORACLE["op12_merkle_manifest"]) is None
