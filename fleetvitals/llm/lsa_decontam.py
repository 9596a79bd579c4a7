"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most 64 words. Words are weighted by the inverse of the
number of documents that hold them, counted over all documents. A randomised SVD, whose products
with the TF-IDF matrix Spark adds up over passages, gives latent coordinates; it is fitted on all
passages of the benchmark and of all documents, whose known words are written down once as numbers
for it. Every document is then
searched whole by windows of 8, 16, 32 and 64 words every 8 words. A find has 60 % of a passage's
words in common order, so of its rarest 40 % and ``RARE`` more words the window holds ``RARE``: only
windows that do are projected, and compared by cosine with the passages whose rare words they hold.
That leaves out nothing that the next check would take, whatever the host's other words or the number
of documents. Candidates are checked by the longest common subsequence of words; where it falls short
of a copy, the words of the answer must be there as well.

The benchmark is taken in blocks of about ``BLOCK_BYTES``, one after the other, so what tasks hold
does not grow with it. Documents are read in place and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm._scratch import settle

PASSAGE = 64
STRIDE = 8
#: Each is twice the one before; the first is ``STRIDE``.
WINDOWS = (8, 16, 32, 64)
RANK = 64
OVERSAMPLE = 8
#: For trials: a basis of about so many documents, twice that at most. None takes them all.
SAMPLE_DOCUMENTS: int | None = None
BLOCK_BYTES = 512 << 10
MIN_COSINE = 0.5
COPY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.5
MARGIN = 12
#: Bytes of text that are searched at once; arrays over windows are several times as large.
SLICE_BYTES = 1 << 20
#: Rare words of a passage that a window has to hold before it is projected.
RARE = 3
AT_ONCE = 1000
#: Words whose part of the TF-IDF matrix is built at once, or a text's if it has more.
PORTION = 1 << 17
#: Cells of the TF-IDF matrix that are multiplied at once; their rows stay in a core's cache.
BLOCK_CELLS = 1024
#: Cells of the table of windows by words that says which passage words a window holds.
CELLS = 4 << 20


def _hasher() -> _text.Hasher:
    return _text.Hasher(81, _text.LOWER)


def _hashes(t: _text.Texts, hasher: _text.Hasher) -> tuple[_text.Words, np.ndarray]:
    t = _text.latin_folded(t)
    w = _text.words(t, _text.ALNUM)
    return w, hasher.of(t.data, w.start, w.end)


@dataclass
class Passages:
    """Of a block of items: their texts, the words, item and answer's words of each passage, and
    all words."""

    texts: list[str]
    item: list[str | None]
    words: list[np.ndarray]
    answer: list[np.ndarray]
    vocabulary: np.ndarray


def passages(items: list[tuple]) -> Passages:
    """Cuts (id, text, answer) into passages; the last quarter stands for a missing answer."""
    hasher, out = _hasher(), Passages([text for _, text, _ in items], [], [], [], np.empty(0, np.uint64))
    for item, text, answer in items:
        own = _hashes(_text.texts(pa.array([text or ""])), hasher)[1]
        told = _hashes(_text.texts(pa.array([answer or ""])), hasher)[1]
        for at in range(0, len(own), PASSAGE):
            part = own[at : at + PASSAGE] if len(own) - at >= PASSAGE // 2 or at == 0 else own[-PASSAGE:]
            out.item.append(None if item is None else str(item))
            out.words.append(part)
            out.answer.append(told if len(told) else part[-max(3, len(part) // 4) :])
    if out.words:
        out.vocabulary = np.unique(np.concatenate(out.words))
    return out


def _numbers(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, or -1."""
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[place] == h, place, -1)


def known_words(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per text, its words that the vocabulary has, as numbers that ascend within each half passage,
    and how many every half passage with any has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for _, t in _text.slices(batches, "_llm_text", SLICE_BYTES):
            w, h = _hashes(t, hasher)
            v = _numbers(h, vocabulary)
            at = np.flatnonzero(v >= 0)
            text = np.searchsorted(w.first, at, "right") - 1
            half = (at - w.first[text]) // (PASSAGE // 2)
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (half[1:] != half[:-1])])[: len(at)]
            words = np.sort(np.cumsum(new) * len(vocabulary) + v[at]) % len(vocabulary)
            cut = np.flatnonzero(new)
            every = np.arange(len(t) + 1)
            columns = (np.searchsorted(text, every), words), (np.searchsorted(text[cut], every), np.diff(np.append(cut, len(at))))
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x, pa.int32())) for o, x in columns]
            yield pa.record_batch(lists, names=["words", "held"])

    return texts.mapInArrow(run, "words array<int>, held array<int>")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of some texts at a time: each text's number of words, all words, and those of each half passage."""
    for batch in batches:
        own, held = batch.column("words"), batch.column("held")
        ends, at = np.cumsum(own.value_lengths().to_numpy()), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
            words = own.slice(at, to - at)
            yield words.value_lengths().to_numpy(), words.flatten().to_numpy(), held.slice(at, to - at).flatten().to_numpy()
            at = to
    _text.release()


def document_counts(known: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of texts, and of those that hold each of ``size`` words, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size, np.int64), 0
        for counts, v, _ in _portions(batches):
            both = np.unique(np.repeat(np.arange(len(counts)), counts) * size + v)
            seen += np.bincount(both % size, minlength=size)
            n += len(counts)
        if n:
            held = np.flatnonzero(seen)
            yield pa.record_batch([pa.array(np.append(held, -1)), pa.array(np.append(seen[held], n))], names=["word", "n"])

    found = known.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    by_word = dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    return by_word.pop(-1, 0), np.array([by_word.get(i, 0) for i in range(size)], float)


def _add_rows(out: np.ndarray, to: np.ndarray, source: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Adds ``value`` times the row ``at`` of ``source`` to the row ``to`` of ``out``; ``to`` ascends."""
    for lo in range(0, len(to), BLOCK_CELLS):
        part = to[lo : lo + BLOCK_CELLS]
        rows = source[at[lo : lo + BLOCK_CELLS]] * value[lo : lo + BLOCK_CELLS, None]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[part[cut]] += np.add.reduceat(rows, cut, axis=0)


def _product(known: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'A times ``right``, for the matrix A whose rows are the unit TF-IDF vectors of half passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(right)
        for _, v, sizes in _portions(batches):
            if not len(v):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            cell = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (row[1:] != row[:-1])]))
            count = np.diff(np.append(cell, len(v)))
            row, v = row[cell], v[cell]
            value = count * idf[v]
            value /= np.sqrt(np.bincount(row, value**2))[row]
            middle = np.zeros((len(sizes), right.shape[1]))
            _add_rows(middle, row, right, v, value)
            by_word = np.argsort(v, kind="stable")
            _add_rows(total, v[by_word], middle, row[by_word], value[by_word])
        held = np.flatnonzero(total.any(axis=1))
        if len(held):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(total[held].ravel()), right.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(held), rows], names=["word", "row"])

    sums = [F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(right.shape[1])]
    found = known.mapInArrow(run, "word bigint, row array<double>").groupBy("word").agg(*sums).toArrow()
    out = np.zeros_like(right)
    if found.num_rows:
        out[found["word"].to_numpy()] = np.column_stack([found[f"c{k}"].to_numpy() for k in range(right.shape[1])])
    return out


def latent_basis(texts: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words by rank) by a randomised range finder with one power step.

    ``texts`` has the texts, or their ``known_words``."""
    known = settle(known_words(texts, vocabulary)) if "_llm_text" in texts.columns else texts
    width = min(rank + OVERSAMPLE, len(vocabulary))
    guess = np.random.default_rng(8).standard_normal((len(vocabulary), width))
    q, _ = np.linalg.qr(_product(known, idf, guess))
    squares, turn = np.linalg.eigh(q.T @ _product(known, idf, q))
    return (q @ turn[:, np.argsort(-squares)])[:, :rank]


@dataclass
class Index:
    passages: Passages
    idf: np.ndarray
    words: np.ndarray
    queries: np.ndarray

    def __post_init__(self) -> None:
        """Word numbers of each passage, filled up with a number that no window holds."""
        held = self.passages
        self.sizes = np.array([len(p) for p in held.words])
        self.table = np.full((len(held.words), PASSAGE), len(held.vocabulary))
        # A find holds ``need`` words of the passage, so of the rarest size - need + RARE it holds RARE.
        self.need = np.ceil(PARAPHRASE * self.sizes - 1e-9).astype(np.int64)
        self.rare = np.minimum(RARE, self.need)
        pairs = [np.empty((2, 0), np.int64)]
        for i, p in enumerate(held.words):
            self.table[i, : len(p)] = number = _numbers(p, held.vocabulary)
            rarest = number[np.argsort(-self.idf[number], kind="stable")][: len(p) - self.need[i] + self.rare[i]]
            rarest = np.unique(rarest)
            pairs.append(np.stack([rarest, np.full(len(rarest), i)]))
        word, passage = np.concatenate(pairs, axis=1)
        order = np.argsort(word, kind="stable")
        #: Passages that have a word among their rarest, word after word.
        self.pointed = passage[order]
        self.points = np.searchsorted(word[order], np.arange(len(held.vocabulary) + 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def build(docs: DataFrame, held: Passages, text_col: str = "text") -> Index:
    spark = docs.sparkSession
    # Written down: texts are hashed once for the counts and both products of the basis.
    known = settle(known_words(docs.select(F.col(text_col).alias("_llm_text")), held.vocabulary))
    n, df = document_counts(known, len(held.vocabulary))
    idf = np.log((1 + n) / (1 + df)) + 1
    if SAMPLE_DOCUMENTS is not None:
        one_in = F.pmod(F.xxhash64("words"), F.lit(max(1, n // SAMPLE_DOCUMENTS)))
        known = settle(known.where(one_in == 0).distinct().limit(2 * SAMPLE_DOCUMENTS))
    # Written as well: a product then takes one Python worker per task, not one more for these words.
    own = settle(known_words(spark.createDataFrame([(x,) for x in held.texts], "_llm_text string").coalesce(1), held.vocabulary))
    number = {int(h): i for i, h in enumerate(held.vocabulary)}
    basis = latent_basis(known.unionByName(own), held.vocabulary, idf)
    words = (idf[:, None] * basis).astype(np.float32)
    queries = np.stack([words[[number[int(h)] for h in p]].sum(axis=0) for p in held.words])
    return Index(held, idf, words, _unit(queries).astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _checked(passage: list[int], answer: list[int], window: list[int]) -> float:
    """Share of the passage in common order if it is a copy or an answered paraphrase, else 0."""
    share = common_subsequence(passage, window) / len(passage)
    if share >= COPY:
        return share
    if share < PARAPHRASE:
        return 0.0
    here = set(window)
    return share if sum(x in here for x in answer) >= ANSWER * len(answer) else 0.0


def _places(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges and of all places in them, in a row."""
    n = end - start
    return np.repeat(np.arange(len(n)), n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _stride_sums(v: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sum of the word vectors of each range; ``v`` has the word numbers, -1 where there is none."""
    out = np.zeros((len(start), words.shape[1]), np.float32)
    for at in range(0, len(start), 1 << 10):
        row, place = _places(start[at : at + (1 << 10)], end[at : at + (1 << 10)])
        row, place = row[v[place] >= 0], place[v[place] >= 0]
        if len(place):
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[at + row[cut]] = np.add.reduceat(words[v[place]], cut, axis=0)
    return out


def _runs(v: np.ndarray, w: _text.Words, index: Index) -> tuple[np.ndarray, ...]:
    """Where a text holds enough rare words of a passage, near enough to share a window: (text,
    passage, place of the first, place of the last), one for every such word as the first."""
    place = np.flatnonzero(v >= 0)
    many = index.points[v[place] + 1] - index.points[v[place]]
    place, many = place[many > 0], many[many > 0]
    row, at = _places(index.points[v[place]], index.points[v[place]] + many)
    passage, place = index.pointed[at], place[row]
    text = np.searchsorted(w.first, place, "right") - 1
    key = text * len(index.sizes) + passage
    order = np.argsort(key, kind="stable")
    key, place, passage, text = key[order], place[order], passage[order], text[order]
    last = np.arange(len(key)) + index.rare[passage] - 1
    here = last < len(key)
    here[here] = key[last[here]] == key[here]
    here[here] = place[last[here]] - place[here] < WINDOWS[-1] + 2 * MARGIN
    return text[here], passage[here], place[here], place[last[here]]


def _enough(v: np.ndarray, low: np.ndarray, high: np.ndarray, passage: np.ndarray, index: Index) -> np.ndarray:
    """Whether the words from ``low`` to ``high`` hold as many of the passage's as a find must: no
    more can be in common order."""
    out, vocabulary = np.zeros(len(low), bool), len(index.passages.vocabulary)
    at_once = max(20, min(AT_ONCE, CELLS // (vocabulary + 1)))
    for at in range(0, len(low), at_once):
        p = passage[at : at + at_once]
        region, i = np.unique(np.stack([low[at : at + at_once], high[at : at + at_once]]), axis=1, return_inverse=True)
        row, place = _places(*region)
        known = v[place] >= 0
        holds = np.zeros((region.shape[1], vocabulary + 1), bool)
        holds[row[known], v[place[known]]] = True
        out[at : at + at_once] = holds[i.ravel()[:, None], index.table[p]].sum(axis=1) >= index.need[p]
    return out


def hits(t: _text.Texts, index: Index, hasher: _text.Hasher) -> dict[int, list[tuple]]:
    """By text, (item, share in order, cosine, first word, last word) of every item found, the best
    of each, best first."""
    held = index.passages
    w, h = _hashes(t, hasher)
    if not len(h):
        return {}
    v = _numbers(h, held.vocabulary)
    inside = np.concatenate([[0], np.cumsum(v >= 0)])
    text, passage, head, tail = _runs(v, w, index)
    found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    first, stop = w.first[text], w.first[1:][text]
    # All windows that can hold a run lie in the widest one's reach on either side of it.
    reach = WINDOWS[-1] + 2 * MARGIN
    wanted = _enough(v, np.maximum(first, tail - reach + 1), np.minimum(stop, head + reach), passage, index)
    text, passage, head, tail, first, stop = (x[wanted] for x in (text, passage, head, tail, first, stop))
    for length in WINDOWS if len(text) else ():
        # Numbers of the windows in the text that, with their margin, hold all of a run.
        low = np.maximum(0, -(-(tail - length - MARGIN + 1 - first) // STRIDE))
        high = np.minimum((head + MARGIN - first) // STRIDE, (stop - first - 1) // STRIDE)
        run, k = _places(low, np.maximum(low, high + 1))
        start, own = np.unique(np.stack([first[run] + STRIDE * k, passage[run]]), axis=1)
        begin, end_of = (w.first[np.searchsorted(w.first, start, "right") + d] for d in (-1, 0))
        end = np.minimum(start + length, end_of)
        low, high = np.maximum(begin, start - MARGIN), np.minimum(end_of, end + MARGIN)
        can = (inside[high] - inside[low] >= index.need[own]) & (inside[end] > inside[start])
        can[can] = _enough(v, low[can], high[can], own[can], index)
        start, end, own, begin = start[can], end[can], own[can], begin[can]
        for at in range(0, len(start), AT_ONCE):
            s, e, p = (x[at : at + AT_ONCE] for x in (start, end, own))
            asked, i = np.unique(s, return_index=True)
            vectors = _unit(_stride_sums(v, asked, e[i], index.words))
            cosine = np.einsum("ij,ij->i", vectors[np.searchsorted(asked, s)], index.queries[p])
            near = cosine >= MIN_COSINE
            here = np.searchsorted(w.first, s[near], "right") - 1
            for x, q, *window in zip(here.tolist(), p[near].tolist(), cosine[near].tolist(), s[near].tolist(), e[near].tolist()):
                found.setdefault((x, q), []).append(tuple(window))
    best: dict[int, dict] = {}
    for (i, p), windows in found.items():
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        passage, answer = held.words[p].tolist(), held.answer[p].tolist()
        for cosine, s, e in sorted(windows, key=lambda x: (-x[0], x[1], x[2])):
            s, e = max(lo, s - MARGIN), min(hi, e + MARGIN)
            share = _checked(passage, answer, h[s:e].tolist())
            if share:
                one = (held.item[p], round(share, 6), round(cosine, 4), s - lo, e - lo - 1)
                old = best.setdefault(i, {}).get(held.item[p])
                if old is None or (one[1], one[2]) > (old[1], old[2]):
                    best[i][held.item[p]] = one
                if share >= COPY:
                    break
    return {i: sorted(x.values(), key=lambda o: (-o[1], -o[2], str(o[0]))) for i, x in best.items()}


def blocks(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", answer_col: str = "answer") -> Iterator[Passages]:
    """The benchmark's passages, a bounded block at a time. Items without words have none."""
    answer = F.col(answer_col) if answer_col in bench.columns else F.lit(None).cast("string")
    rows = bench.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"), answer.cast("string").alias("answer")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text")
        items = [tuple(r) for r in part.collect()]  # about BLOCK_BYTES
        held = passages(items)
        if held.words:
            yield held


FOUND = "array<struct<item:string,share:double,cosine:double,first_word:bigint,last_word:bigint>>"
_FOUND = pa.list_(pa.struct([("item", pa.string()), ("share", pa.float64()), ("cosine", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
_FIELDS = ("item", "share", "cosine", "first_word", "last_word")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``found``, the items that its text contains, best first.

    Items with equal shares stand by cosine, then by their id as text; an item found at several places
    is told once, at the best and then first one. Null and empty texts contain none, an empty benchmark finds none, repeated rows give repeated
    rows, null ids stay null, and other columns are not read."""
    out = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"), F.array().cast(FOUND).alias("found"))
    shape = out.schema
    for held in blocks(bench):
        index = build(docs, held, text_col)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            hasher = _hasher()
            for batch, t in _text.slices(batches, "_llm_text", SLICE_BYTES):
                found = batch.column("found").to_pylist()
                for i, own in hits(t, index, hasher).items():
                    found[i] = found[i] + [dict(zip(_FIELDS, x)) for x in own]
                yield pa.record_batch([batch.column("_llm_id"), batch.column("_llm_text"), pa.array(found, _FOUND)], names=["_llm_id", "_llm_text", "found"])

        out = out.mapInArrow(run, shape)
    return out.select(F.col("_llm_id").alias(id_col), "found")


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark item, all columns as they are.

    Null and empty texts stay, repeated rows stay or go together, an empty benchmark takes nothing
    away, an empty table gives an empty one, and extra columns pass through whatever their names."""
    column, out = docs.columns.index(text_col), docs
    for held in blocks(bench):
        index = build(docs, held, text_col)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            hasher = _hasher()
            for batch in batches:
                named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
                for part, t in _text.slices(iter([named]), f"c{column}", SLICE_BYTES):
                    clean = np.ones(len(t), bool)
                    clean[list(hits(t, index, hasher))] = False
                    yield part.filter(pa.array(clean)).rename_columns(batch.schema.names)

        out = out.mapInArrow(run, docs.schema)
    return out
