"""Licence scan: ordered signature rules over whole texts.

A text's words are lower-case runs of digits, letters and characters beyond ASCII. Word hashes find
the documents that hold a rule's keyword; only those are normalised, and only the rules whose
keyword is there run over them. Detections are taken by priority, then length, then place; one that
lies within an interval already taken is suppressed. Rows are independent, so there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm.license_rules import Rule, rules

DETECTION = "struct<label:string,priority:int,start:bigint,words:bigint,base:boolean,kept:boolean>"


class Scanner:
    def __init__(self, table: list[Rule]) -> None:
        self.hasher = _text.Hasher(11, _text.LOWER)
        self.by_keyword: dict[int, list[Rule]] = {}
        for rule in table:
            self.by_keyword.setdefault(int(self._hash(rule.keyword)), []).append(rule)
        self.known = np.array(sorted(self.by_keyword), np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.known >> np.uint64(48)] = True

    def _hash(self, word: bytes) -> np.uint64:
        data = np.frombuffer(word, np.uint8)
        return self.hasher.of(data, np.array([0]), np.array([len(data)]))[0]

    def keywords(self, t: _text.Texts, w: _text.Words) -> dict[int, set[int]]:
        """By text, the hashes of the keywords that it holds."""
        h = self.hasher.of(t.data, w.start, w.end)
        at = np.flatnonzero(self.seen[h >> np.uint64(48)])
        place = np.searchsorted(self.known, h[at])
        at = at[(place < len(self.known)) & (self.known[np.minimum(place, len(self.known) - 1)] == h[at])]
        found: dict[int, set[int]] = {}
        for text, key in zip((np.searchsorted(w.first, at, "right") - 1).tolist(), h[at].tolist()):
            found.setdefault(text, set()).add(key)
        return found

    def detect(self, joined: bytes, keys: set[int]) -> list[tuple]:
        found = []
        for key in keys:
            for rule in self.by_keyword[key]:
                for m in rule.pattern.finditer(joined):
                    start = joined.count(b" ", 0, m.start())
                    found.append((rule.label, rule.priority, start, m[0].count(b" ") + 1, rule.base))
        return resolved(found)


def resolved(found: list[tuple]) -> list[tuple]:
    """The detections with a last field ``kept``: not within one that ranks higher. A prefix
    maximum of taken ends by start answers each question in logarithmic time."""
    found = sorted(set(found), key=lambda d: (-d[1], -d[3], d[2], d[0], not d[4]))
    place = {s: i for i, s in enumerate(sorted({d[2] for d in found}), 1)}
    furthest = [-1] * (len(place) + 1)
    out = []
    for d in found:
        i, end = place[d[2]], d[2] + d[3]
        far, k = -1, i
        while k:
            far = max(far, furthest[k])
            k &= k - 1
        kept = far < end
        if kept:
            while i < len(furthest):
                furthest[i] = max(furthest[i], end)
                i += i & -i
        out.append((*d, kept))
    return sorted(out, key=lambda d: (d[2], d[3], d[0], not d[4]))


_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]+")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, and detections (label, priority, start word,
    number of words, whether a base rule, whether kept after suppression).

    Null and empty texts have no words and no detections. Repeated rows give repeated rows, other
    columns are not read, an empty table gives an empty one, null ids stay null."""
    own = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules() if own is None else own)
        fields = ("label", "priority", "start", "words", "base", "kept")
        for batch, t in _text.slices(batches, "_llm_text"):
            w = _text.words(t, _text.ALNUM)
            found = [[] for _ in range(len(t))]
            for i, keys in scanner.keywords(t, w).items():
                joined = _BREAK.sub(b" ", t.raw(i).lower()).strip(b" ")
                found[i] = [dict(zip(fields, d)) for d in scanner.detect(joined, keys)]
            yield pa.record_batch([batch.column("_llm_id"), pa.array(w.counts, pa.int64()), pa.array(found, _DETECTIONS)], names=["id", "n_words", "detections"])

    ids = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"))
    found = picked.mapInArrow(run, f"id {ids}, n_words bigint, detections array<{DETECTION}>")
    return found.withColumnRenamed("id", id_col)


_DETECTIONS = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("base", pa.bool_()), ("kept", pa.bool_())]))


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last place and label lists of ``license_scan``. The score is one minus the
    product of (1 - priority / 100) over the labels kept, each by its best rule."""
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])
    starts = F.transform(base, lambda d: d["start"])
    names = F.array_distinct(F.transform(kept, lambda d: d["label"]))
    best = F.transform(names, lambda n: F.array_max(F.transform(F.filter(kept, lambda d: d["label"] == n), lambda d: d["priority"])))
    doubt = F.aggregate(F.array_sort(best), F.lit(1.0), lambda left, p: left * (1 - p / 100.0))
    return found.select(
        id_col, "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.filter("detections", lambda d: d["base"] | d["kept"])).alias("labels"),
        F.round(1 - doubt, 6).alias("score"), "detections",
    )
