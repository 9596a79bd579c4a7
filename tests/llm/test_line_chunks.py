from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from fleetvitals.llm import _text, line_chunks


def chunked(text):
    """(word number, hash) of the chunks of one text."""
    _, word, key = line_chunks.chunks(_text.texts(pa.array([text or ""])), line_chunks._hasher())
    return list(zip(word.tolist(), key.tolist()))


def got(df):
    return sorted(((r.doc_id, r.text) for r in line_chunks.line_dedup(df).collect()), key=repr)


def test_repeated_passages_go_and_the_first_stays(documents, prose):
    passages = [prose(n, 600 + n, 5000) for n in (52, 60, 75, 100, 150)]
    rows, at = [], 0
    for p in passages:
        for i in range(8):
            rows.append((at, f"{prose(60, 7000 + at, 5000)} {p} {prose(45, 8000 + at, 5000)}"))
            at += 1
    out = dict(got(documents(rows)))
    assert all(out[i * 8] == rows[i * 8][1] for i in range(5))
    assert not any(passages[i // 8] in out[i] for i in range(40) if i % 8)
    for i in range(40):  # what surrounds the passages stays
        before, after = prose(60, 7000 + i, 5000), prose(45, 8000 + i, 5000)
        assert out[i].startswith(before[:200]) and out[i].endswith(after[-120:])


def test_clean_documents_are_untouched(documents, prose):
    boiler = ["Read more here, please.", "All rights reserved by the owner of it.", "Share this on your page. Or do not."]
    rows = [(i, f"{boiler[i % 3]}\n{prose(90, 4000 + i, 5000)}\n{boiler[(i + 1) % 3]}") for i in range(30)]
    assert got(documents(rows)) == sorted(rows, key=repr)


def test_repeated_rows_and_copies(documents, prose):
    text = prose(100, 12)
    assert got(documents([(1, text), (1, text)])) == [(1, text), (1, text)]
    assert got(documents([(1, text), (2, text), (None, text)])) == sorted([(1, ""), (2, ""), (None, text)], key=repr)  # null ids come first


def test_detail_and_columns(documents, clashing, prose):
    text = prose(100, 13)
    docs = documents([(1, "é " + text), (2, "é " + text), (3, "alone here")])
    out = {r.doc_id: r for r in line_chunks.line_dedup(docs, detail=True).collect()}
    assert out[1].removed_words == 0 and out[1].spans == [] and out[2].removed_words == 101
    assert [(s["start"], s["end"]) for s in out[2].spans] == [(0, len(("é " + text).encode()))]
    plain_out = line_chunks.line_dedup(docs)
    assert plain_out.columns == docs.columns
    assert {r.doc_id: r.n_chars for r in plain_out.collect()} == {1: len(text) + 2, 2: 0, 3: 10}
    extra = clashing([(1, "some fine words")])
    assert [r.asDict() for r in line_chunks.line_dedup(extra).collect()] == [r.asDict() for r in extra.collect()]
    assert line_chunks.line_dedup(documents([])).collect() == []


def test_chunks_move_with_the_text(prose):
    text = prose(400, 14)
    a = {k for _, k in chunked(text)}
    b = {k for _, k in chunked("another line in front.\n" + text)}
    assert len(a & b) >= len(a) - 3
    assert chunked("") == [] and chunked(None) == [] and chunked("few words only") == []
    # the same chunks with other white space
    assert [k for _, k in chunked(text)] == [k for _, k in chunked(text.replace(" ", "  "))]


def test_a_passage_of_fifty_words_shares_a_chunk_wherever_it_stands(prose):
    r, missed = random.Random(5), 0
    for i in range(400):
        p = prose(50, 10_000 + i, 5000)
        p = p.replace(".", "") if i % 2 else p
        hosts = [chunked(f"{prose(r.randint(0, 60), 20_000 + 2 * i + k, 5000)} {p} {prose(r.randint(0, 60), 30_000 + 2 * i + k, 5000)}") for k in (0, 1)]
        missed += not {k for _, k in hosts[0]} & {k for _, k in hosts[1]}
    assert missed <= 1


def test_boundaries_are_the_least_of_a_window(prose):
    """The doubling against windows looked at one by one."""
    r = random.Random(2)
    values = np.array([r.randrange(50) for _ in range(200)], np.uint64)
    least = line_chunks._least(values)
    assert least.tolist() == [min(values[i : i + line_chunks.WINDOW]) for i in range(len(values) - line_chunks.WINDOW + 1)]


def test_runs_hash_the_same_words_alike():
    words = np.array([5, 6, 7, 8, 5, 6, 7, 9], np.uint64)
    runs = line_chunks.Runs(words)
    one, two = (int(runs.of(np.array([a]), np.array([a + 3]))[0]) for a in (0, 4))
    assert one == two and one != int(runs.of(np.array([1]), np.array([4]))[0])


def passages(rows, least=line_chunks.PASSAGE_WORDS):
    """The words of each text that lie in runs of ``least`` words which an earlier text has as well."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        words, gone = t.split(), set()
        grams = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        for k, g in enumerate(grams):
            if g in seen:
                gone.update(range(k, k + least))
        seen.update(grams)
        out[d] = " ".join(x for k, x in enumerate(words) if k not in gone)
    return out


def test_passages_of_just_over_fifty_words_go_whole(documents, prose):
    rows = []
    for k in range(60):
        p = prose(50 + k % 11, 20_000 + k, 5000)
        p = p.replace(".", "") if k % 2 else p
        for j in range(3):
            at = 3 * k + j
            rows.append((at, f"{prose(60, 30_000 + at, 5000)}{' ' if j else chr(10)}{p} {prose(45, 40_000 + at, 5000)}"))
    out = {r.doc_id: r.text for r in line_chunks.line_dedup(documents(rows)).collect()}
    want = passages(rows)
    assert {d: " ".join(t.split()) for d, t in out.items()} == want
    assert sum(len(t.split()) for t in want.values()) == sum(105 + (50 + d // 3 % 11) * (d % 3 == 0) for d in want)


def test_shorter_repeats_and_repeats_within_a_text(documents, prose):
    short, long = prose(49, 1, 5000).replace(".", ""), prose(130, 2, 5000)
    rows = [(i, f"{prose(80, 500 + i, 5000)} {short} {prose(80, 600 + i, 5000)}") for i in range(6)]
    rows += [(20, f"{long} {prose(30, 3, 5000)} {long}"), (21, "x " * 400), (22, "y " * 99 + "x " * 300), (23, long)]
    out = {r.doc_id: r.text for r in line_chunks.line_dedup(documents(rows)).collect()}
    assert all(out[i] == t for i, t in rows[:6])
    assert out[20] == rows[6][1][: -len(long)].rstrip() and out[23] == ""
    assert out[21].count("x") < 100 and out[22].count("x") < 2 * line_chunks.WINDOW and 0 < out[22].count("y") < 99


def test_passages_with_odd_rows(documents, clashing, odd, prose):
    text = prose(100, 12)
    dedup = line_chunks.line_dedup
    assert sorted(((r.doc_id, r.text) for r in dedup(documents(odd)).collect()), key=repr) == sorted(odd, key=repr)
    assert [r.text for r in dedup(documents([(1, text), (1, text)])).collect()] == [text, text]
    assert {r.doc_id: r.text for r in dedup(documents([(1, text), (2, text), (None, text)])).collect()} == {1: "", 2: "", None: text}
    extra = clashing([(1, "é " + text), (2, "é " + text)])
    out = {r.doc_id: r for r in dedup(extra).collect()}
    assert out[1].text == "é " + text and out[2].text == "" and out[2].n_chars == 0 and out[2].body == "xbody"
    one = {r.doc_id: r for r in dedup(extra, detail=True).collect()}[2]
    assert one.removed_words == 101 and [(s["start"], s["end"]) for s in one.spans] == [(0, len(("é " + text).encode()))]
    assert dedup(documents([])).collect() == []


def test_a_passage_that_was_quoted_in_halves_before_goes_everywhere_after(documents, prose):
    r = random.Random(8)
    words = prose(60, 77, 5000).split(" ")
    rows = [(0, f"{prose(50, 1, 5000)} {' '.join(words[:35])} {prose(50, 2, 5000)}"), (1, f"{prose(50, 3, 5000)} {' '.join(words[25:])} {prose(50, 4, 5000)}")]
    rows += [(2 + i, f"{prose(r.randint(9, 50), 100 + i, 5000)} {' '.join(words)} {prose(r.randint(9, 50), 200 + i, 5000)}") for i in range(20)]
    out = dict(got(documents(rows)))
    assert out[0] == rows[0][1] and out[1] == rows[1][1]  # the halves are kept where they were first
    assert not any(" ".join(words[:35]) in out[i] or " ".join(words[25:]) in out[i] for i in range(3, 22))


def test_rows_without_an_id_are_told_by_their_texts(documents, prose):
    passage = prose(80, 31, 5000)
    rows = [(None, f"{prose(30, 500 + i, 5000)} {passage} {prose(30, 600 + i, 5000)}") for i in range(6)]
    out = [r.text for r in line_chunks.line_dedup(documents(rows)).collect()]
    assert sum(passage in t for t in out) == 1


def test_a_line_that_very_many_documents_share_is_met_without_its_key(spark, documents, prose):
    passage = prose(64, 41, 5000)
    rows = [(i, f"{passage} {prose(40, 4000 + i, 5000)}") for i in range(120)] + [(i, prose(90, 9000 + i // 2, 5000)) for i in range(200, 1400)]
    df = documents(rows)
    heavy = line_chunks._repeated(line_chunks.chunk_rows(df))
    plan = heavy._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    out = dict(got(df))
    assert passage in out[0] and not any(passage in out[i] for i in range(1, 120))
    assert all(out[i] == (dict(rows)[i] if i % 2 == 0 else "") for i in range(200, 1400))


def pieces(rows, least=line_chunks.PASSAGE_WORDS, piece=line_chunks.PIECE_WORDS):
    """What is left when every word in ``piece`` words of an earlier place goes, in runs of ``least``."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        words, gone = t.split(), set()
        grams = [tuple(words[k : k + piece]) for k in range(len(words) - piece + 1)]
        for k, g in enumerate(grams):
            if g in seen:
                gone.update(range(k, k + piece))
            seen.add(g)
        run, cut = [], set()
        for k in range(len(words) + 1):
            if k in gone:
                run.append(k)
            else:
                cut.update(run if len(run) >= least else [])
                run = []
        out[d] = " ".join(x for k, x in enumerate(words) if k not in cut)
    return out


def test_mosaics_of_passages_equal_plain_sets(documents, prose):
    r = random.Random(12)
    stock = [prose(r.randint(50, 140), 700 + i, 5000) for i in range(15)]
    rows = []
    for d in range(80):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(prose(r.randint(5, 60), 5000 + 10 * d + len(parts), 5000))
            parts.append(r.choice(stock))
        rows.append((d, " ".join(parts)))
    out = {r.doc_id: " ".join(r.text.split()) for r in line_chunks.line_dedup(documents(rows)).collect()}
    want = pieces(rows)
    assert sum(out[d] != want[d] for d in want) == 0
