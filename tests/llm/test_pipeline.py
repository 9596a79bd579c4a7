from __future__ import annotations

import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fleetvitals.llm import best_fit_pack, queries
from fleetvitals.llm._scratch import settle
from tests.llm import brute
from tests.llm.test_line_chunks import passages


def test_stages_on_given_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            own = {r.doc_id: r for r in before.collect()}
            assert all(r.doc_id in own and (name == "line_dedup" or own[r.doc_id] == r) for r in rows[name])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    assert len(rows["toxicity"]) < 1000 and len(rows["line_dedup"]) == len(rows["toxicity"])
    insult = re.compile(r"\b(idiot|moron|scum|clown|pathetic|worthless|loser|trash|stupid|disgusting)\b", re.I)
    assert sum(len(insult.findall(r.text)) > 3 for r in rows["toxicity"]) <= 2

    left = {r.doc_id: r.text or "" for r in rows["line_dedup"]}
    without = passages([(r.doc_id, r.text or "") for r in rows["toxicity"]])
    assert all(len(left[d].split()) <= len(t.split()) for d, t in without.items())  # nothing of 50 words stays
    listed = [(r.doc_id, r.text) for r in rows["line_dedup"]]
    comps = brute.jaccard_components(listed, 5, 80)
    kept = {d for (d, n, c), (_, t) in zip(comps, listed) if not n or c == d}
    assert {r.doc_id for r in rows["ngram_join"]} == kept
    assert {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["decontamination"]}
    totals = {r.doc_id: r.doc_tokens for r in rows["packing"]}
    assert sum(r.length for r in rows["packing"]) == sum(totals.values())


def test_run_packs_and_is_registered(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "start", "sequence_id", "offset"} <= set(out.columns)
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert all(any(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14))


def test_all_documents_gone(spark, documents):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), folder).collect() == [], name


def test_odd_rows_pass_every_stage(spark, clashing, odd, prose):
    """Null ids, ties, repeated rows and extra columns with the operators' own names, all the way."""
    passage = prose(60, 3, 5000)
    rows = [*odd, (None, f"{prose(30, 1, 5000)} {passage}"), (40, f"{prose(30, 2, 5000)} {passage}"), (41, prose(90, 5)), (41, prose(90, 5)), (42, "w " * 40_000)]
    docs = clashing(rows).withColumns({"found": F.lit("mine"), "_key": F.lit("mine"), "kept": F.lit(7)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = settle(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns, name
        got = docs.collect()
        assert {1, 2, 4, 5, 6, 41, None} <= {r.doc_id for r in got}, name
        assert all((r.found, r._key, r.kept) == ("mine", "mine", 7) for r in got), name
        assert {r.text for r in got if r.doc_id in (1, 2, 4)} == {None, "", " \n\t "}, name
    texts = [r.text or "" for r in got]
    assert sum(passage in t for t in texts) == 1 and texts.count(prose(90, 5)) == 1
    packed = best_fit_pack.pack_documents(docs, queries.word_tokenizer()).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in got}
    assert sum(r.start == 0 for r in packed) == len(got)
