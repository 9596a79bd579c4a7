"""Personal data by pattern, and the terms that give it away by how the corpus uses them.

Patterns find e-mail and IP addresses, card and telephone numbers: the protected entities. A term
that stands by an entity tells something of it. With p(e) the chance that any word of the corpus
stands by the entity and p(e|t) the share of the term's occurrences that do, the entity carries
``-log2 p(e)`` bits and the term reveals ``log2(p(e|t) / p(e))`` of them. Their ratio is the term's
disclosure, 1 for a term that stands nowhere else. Terms above one threshold are removed, above a
lower one they are generalised to the kind of word they are.

Windows that are the same word for word count once as support, so a passage that is copied a thousand
times is one witness; a term needs ``SUPPORT`` of them for one entity. Shares are taken over all
occurrences in all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm._scratch import settle
from fleetvitals.llm._text import ALNUM, LOWER, Hasher, Texts, slices, words

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
#: Words on either side of an entity that count as standing by it.
NEAR = 8
#: Different windows of one entity in which a term has to stand.
SUPPORT = 3
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.9
#: So many terms go to the tasks as an array of 9 bytes each; more of them are joined.
MOST_TERMS = 1 << 20
#: Distinct words that a task counts before it hands them on.
_HELD = 1 << 20

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that starts inside a run of digits would have started with the run.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
_OTHER = bytes(b for b in range(256) if not 48 <= b < 58)


def _luhn(digits: bytes) -> bool:
    odd = sum(d - 48 for d in digits[-1::-2])
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[d - 48] for d in digits[-2::-2])) % 10 == 0


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in that order; leftmost, not overlapping within a kind."""
    out = []
    at, floor = raw.find(b"@"), 0
    while at >= 0:
        head = raw[floor:at]
        start = floor + len(head.rstrip(_LOCAL))
        match = _DOMAIN.match(raw, at + 1) if start < at else None
        if match:
            out.append((start, 0, match.end()))
        floor = match.end() if match else at + 1
        at = raw.find(b"@", floor)
    if _DIGIT.search(raw) is None:
        return out
    for match in _IP.finditer(raw):
        if all(len(p) < 4 and int(p or b"0") < 256 for p in (part.lstrip(b"0") for part in match.group().split(b"."))):
            out.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(raw):
        if match.end() - match.start() >= 12:
            digits = match.group().translate(None, _OTHER)
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((match.start(), 2, match.end()))
    if b"+" in raw:
        for match in _PHONE.finditer(raw):
            if 9 <= len(match.group().translate(None, _OTHER)) <= 15:
                out.append((match.start(), 3, match.end()))
    return sorted(out)


def entity(raw: bytes, start: int, kind: int, end: int) -> bytes:
    """16 bytes that name an entity: e-mail addresses in any case, numbers by their digits."""
    value = raw[start:end]
    value = value.lower() if kind == 0 else value if kind == 1 else value.translate(None, _OTHER)
    return hashlib.sha256(KINDS[kind].encode() + b":" + value).digest()[:16]


def _outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that touch no span."""
    touched = np.zeros(len(start) + 1, np.int64)
    for a, _, b in spans:
        touched[np.searchsorted(end, a, "right")] += 1
        touched[np.searchsorted(start, b)] -= 1
    return np.cumsum(touched[:-1]) == 0


def _contexts(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """A row per mention of an entity with the different words by it, and a row per slice with the
    number of its words."""
    hasher = Hasher(13, LOWER)
    term = pa.struct([("hash", pa.int64()), ("word", pa.string())])
    for _, t in slices(batches, "text"):
        entities, windows, terms = [None], [None], [None]
        counts = [len(words(t, ALNUM))]
        for i in range(len(t)):
            raw = t.raw(i)
            spans = base_spans(raw)
            if not spans:
                continue
            one = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            w = words(one, ALNUM)
            free = _outside(w.start, w.end, spans)
            start, end = w.start[free], w.end[free]
            hashes = hasher.of(one.data, start, end).view(np.int64)
            for a, kind, b in spans:
                lo = max(0, int(np.searchsorted(start, a)) - near)
                hi = int(np.searchsorted(start, b)) + near
                window = hashes[lo:hi]
                first = {h: k for k, h in reversed(list(enumerate(window.tolist())))}
                entities.append(entity(raw, a, kind, b))
                windows.append(hashlib.sha256(window.tobytes()).digest()[:16])
                terms.append([{"hash": h, "word": raw[start[lo + k] : end[lo + k]].translate(LOWER.tobytes()).decode("utf-8", "replace")} for h, k in first.items()])
                counts.append(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(entities, pa.binary()), pa.array(windows, pa.binary()), pa.array(terms, pa.list_(term)), pa.array(counts, pa.int64())],
            names=["entity", "window", "terms", "words"],
        )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of the words of a task's texts, added up as far as ``_HELD`` words go."""
    hasher = Hasher(13, LOWER)
    keys, sums = np.empty(0, np.uint64), np.empty(0, np.int64)

    def written() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["hash", "n"])

    for _, t in slices(batches, "text"):
        w = words(t, ALNUM)
        some, n = np.unique(hasher.of(t.data, w.start, w.end), return_counts=True)
        both = np.concatenate([keys, some])
        keys, back = np.unique(both, return_inverse=True)
        sums = np.bincount(back, np.concatenate([sums, n]), len(keys)).astype(np.int64)
        if len(keys) >= _HELD:
            yield written()
            keys, sums = keys[:0], sums[:0]
    if len(keys):
        yield written()


def fit(df: DataFrame, text: str = "text", near: int = NEAR, support: int = SUPPORT) -> DataFrame:
    """(hash, word, disclosure, action) of the terms that reveal an entity, from all rows of ``df``.

    Counted are all words outside the entities. Null and empty texts say nothing; repeated rows and
    copies add occurrences but no support. Without entities, or on an empty table, there are no
    terms. A word is told by a 64-bit hash; of two that share one, the counts are added, which only
    lowers the disclosure."""
    texts = df.select(F.col(f"`{text}`").alias("text"))
    seen = settle(texts.mapInArrow(partial(_contexts, near=near), "entity binary, window binary, terms array<struct<hash: bigint, word: string>>, words bigint"))
    total = seen.agg(F.sum("words")).first()[0] or 0
    windows = settle(seen.where("entity IS NOT NULL").groupBy("entity", "window").agg(F.count("*").alias("mentions"), F.first("terms").alias("terms")))
    entities = windows.groupBy("entity").agg(F.count("*").alias("_windows"), F.sum("mentions").alias("of_entity")).where(F.col("_windows") >= support)
    near_by = windows.join(entities.select("entity"), "entity", "left_semi").select("entity", "mentions", F.explode("terms").alias("term"))
    pairs = near_by.groupBy("entity", F.col("term.hash").alias("hash")).agg(F.count("*").alias("support"), F.sum("mentions").alias("together"), F.min("term.word").alias("word"))
    pairs = settle(pairs.where(F.col("support") >= support).join(entities.drop("_windows"), "entity"))
    asked = pairs.select("hash").distinct()
    counts = texts.mapInArrow(_word_counts, "hash bigint, n bigint").join(asked, "hash", "left_semi").groupBy("hash").agg(F.sum("n").alias("n"))
    chance = F.least(F.lit(1.0), F.col("of_entity") * F.lit(2.0 * near) / F.lit(float(max(1, total))))
    share = F.least(F.lit(1.0), F.col("together") / F.col("n"))
    bits = -F.log2(chance)
    told = F.when(bits > 0, F.log2(share / chance) / bits).otherwise(F.lit(0.0))
    best = pairs.join(counts, "hash").groupBy("hash").agg(F.min("word").alias("word"), F.max(told).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return settle(best.withColumn("action", F.when(F.col("disclosure") >= REMOVE, ACTIONS[1]).otherwise(ACTIONS[0])))


def _kind_of_word(word: str) -> str:
    if word.isdigit():
        return "[NUMBER]"
    if any(c.isdigit() for c in word):
        return "[CODE]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitised(raw: bytes, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced; spans that overlap go as one, named by the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while (k := k + 1) < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
        out.append(raw[at:start].decode("utf-8", "replace"))
        word = raw[start:end].decode("utf-8", "replace")
        out.append(f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else _kind_of_word(word) if kind == len(KINDS) else "")
        at = end
    return "".join([*out, raw[at:].decode("utf-8", "replace")])


def _found(batches: Iterator[pa.RecordBatch], terms: tuple[np.ndarray, np.ndarray] | None, texts: bool) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(13, LOWER)
    for part, t in slices(batches, "text"):
        w = words(t, ALNUM)
        hashes = hasher.of(t.data, w.start, w.end).view(np.int64)
        if terms is None:
            lists = part.column("terms")
            counts = np.array([len(x) if x.is_valid else 0 for x in lists])
            flat = [y for x in lists if x.is_valid for y in x.as_py()]
            mine = np.concatenate([[0], np.cumsum(counts)])
            known, kinds = np.array([y["hash"] for y in flat], np.int64), np.array([y["remove"] for y in flat], bool)
        else:
            known, kinds = terms
            place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
        columns: list[list] = [[] for _ in range(6 + texts)]
        for i in range(len(t)):
            raw, first, last, begin = t.raw(i), w.first[i], w.first[i + 1], t.offsets[i]
            base = base_spans(raw)
            if terms is None:
                own = dict(zip(known[mine[i] : mine[i + 1]].tolist(), kinds[mine[i] : mine[i + 1]].tolist()))
                at = np.array([k for k in range(first, last) if int(hashes[k]) in own] if own else [], np.int64)
                harsh = np.array([own[int(hashes[k])] for k in at], bool)
            else:
                at = first + np.flatnonzero(hit[first:last])
                harsh = kinds[place[at]] if len(at) else np.empty(0, bool)
            start, end = w.start[at] - begin, w.end[at] - begin
            free = _outside(start, end, base)
            more = [(int(a), len(KINDS) + int(h), int(b)) for a, h, b in zip(start[free], harsh[free], end[free])]
            spans = sorted([*base, *more])
            point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]) if spans and not raw.isascii() else None
            name = (*KINDS, *ACTIONS)
            told = [f"{name[k]}:{a}:{b}" if point is None else f"{name[k]}:{point[a]}:{point[b]}" for a, k, b in spans]
            only = ",".join(x for x, (_, k, _) in zip(told, spans) if k < len(KINDS))
            for column, value in zip(columns, (*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(only.encode()).hexdigest(), ",".join(told))):
                column.append(value)
            if texts:
                columns[6].append(sanitised(raw, spans))
        kinds_of = [pa.int64()] * 4 + [pa.string()] * (2 + texts)
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"][: 6 + texts]
        yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds_of))], names=["id", *names])


def find(df: DataFrame, model: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = False, most_terms: int = MOST_TERMS) -> DataFrame:
    """One row per row of ``df``: its id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``,
    ``base_sha256`` (of the pattern spans) and ``spans`` (these, ``generalise`` and ``remove``), by
    start, then kind; offsets in code points. ``with_text`` adds ``clean_text`` without them.

    A null text counts as empty and has no spans; a null id stays null; repeated rows are answered one
    by one. A term that touches a pattern's span is part of it and has no span of its own. Other
    columns, whatever their names, take no part. Texts of any length are read whole. A model of up to
    ``most_terms`` terms goes to the tasks; a larger one is joined to the words of each different text."""
    rows = df.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    few = model.select("hash", (F.col("action") == ACTIONS[1]).alias("remove"))
    held = few.limit(most_terms + 1).collect()
    terms = None
    if len(held) <= most_terms:
        held.sort()
        terms = (np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], bool))
    else:
        keyed = rows.withColumn("key", F.sha2("text", 256))
        said = keyed.select("key", "text").mapInArrow(_distinct_words, "key string, hash bigint")
        hits = said.join(few, "hash").groupBy("key", "hash").agg(F.first("remove").alias("remove"))
        lists = hits.groupBy("key").agg(F.collect_list(F.struct("hash", "remove")).alias("terms"))
        rows = keyed.join(lists, "key", "left").select("id", "text", "terms")
    kind = df.schema[id].dataType.simpleString()
    columns = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" + (", clean_text string" if with_text else "")
    return rows.mapInArrow(partial(_found, terms=terms, texts=with_text), f"id {kind}, {columns}").withColumnRenamed("id", id)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(13, LOWER)
    for part, t in slices(batches, "text"):
        w = words(t, ALNUM)
        pairs = np.unique(np.stack([w.text_of(), hasher.of(t.data, w.start, w.end).view(np.int64)]), axis=1) if len(w) else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(pairs[0])), pa.array(pairs[1])], names=["key", "hash"])
