"""Language identification in two steps: the family first, then the language within it.

Both steps are linear support vector machines between two classes each, one against one, over the
relative frequencies of hashed letter 2-, 3- and 4-grams. A text meets the machines between families,
and then only those of the family that won. Votes are margins; the score is the product of the two
steps' confidence. Codes of no known family are put together by how alike their letters are, into
about as many families as there are codes in each, so machines stay few. They are fitted on at most
``MAX_ROWS`` different texts, as many of each of at most ``MAX_LANGUAGES`` languages, chosen by the hash
of their text; prediction reads every whole text in place, so it needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm._scratch import settle

BITS = 12
GRAMS = (2, 3, 4)
MAX_ROWS = 2_000
#: The languages with the most texts are learned, so many at most.
MAX_LANGUAGES = 200
#: Texts whose vectors are held at once.
AT_ONCE = 256
COST = 10.0
UNKNOWN = "und"

#: Families of common language codes; others are put together by their letters.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "cjk": "ja ko zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str | None:
    return _FAMILY.get(lang.lower().partition("-")[0])


def grouped(means: dict[str, np.ndarray]) -> dict[str, str]:
    """A family for each language without one, named by its first: about the square root of their
    number, each around the language that is least like those before it."""
    names = sorted(means)
    if not names:
        return {}
    x = np.stack([means[n] / max(np.linalg.norm(means[n]), 1e-12) for n in names])
    centres = [0]
    near = x @ x[0]
    while len(centres) < np.ceil(np.sqrt(len(names))):
        centres.append(int(near.argmin()))
        near = np.maximum(near, x @ x[centres[-1]])
    of = (x @ x[centres].T).argmax(axis=1)
    first = {k: next(n for n, o in zip(names, of) if o == k) for k in set(of.tolist())}
    return {n: first[k] for n, k in zip(names, of.tolist())}


#: Lower case; digits, signs and white space are one blank.
_FOLD = _text.LOWER.copy()
_FOLD[~_text.ALNUM] = 32
_FOLD[48:58] = 32


def _grams(t: _text.Texts) -> Iterator[tuple[int, np.ndarray]]:
    """For each length k the bucket of the gram that begins at each byte."""
    data = _FOLD[_text.latin_folded(t).data].astype(np.uint32)
    n = len(data)
    for k in GRAMS:
        h = np.full(max(0, n - k + 1), k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ data[j : n - k + 1 + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        yield k, (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _ranges(t: _text.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each text: from its first byte to the last that starts a whole gram."""
    first = t.offsets[:-1]
    return first, np.maximum(first, t.offsets[1:] - k + 1)


def vectors(t: _text.Texts, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray]]:
    """Texts by buckets, so many texts at a time, with the number of the first; the grams of one
    length together weigh one."""
    grams = [(bucket.astype(np.uint16), *_ranges(t, k)) for k, bucket in _grams(t)]
    for first in range(0, len(t), at_once):
        out = np.zeros((min(at_once, len(t) - first), 1 << BITS), np.float32)
        for bucket, low, high in grams:
            for i, (lo, hi) in enumerate(zip(low[first : first + at_once].tolist(), high[first : first + at_once].tolist())):
                if hi > lo:
                    out[i] += np.bincount(bucket[lo:hi], minlength=1 << BITS) / (hi - lo)
        yield first, out


def lettered(t: _text.Texts) -> np.ndarray:
    """Whether each text has a letter."""
    marks = np.zeros(256, bool)
    marks[65:91] = marks[97:123] = True
    seen = np.concatenate([[0], np.cumsum(marks[t.data], dtype=np.int64)])
    out = seen[t.offsets[1:]] > seen[t.offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in t.raw(i).decode("utf-8", "replace"))
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights (the last for a constant) of a linear machine with squared hinge loss, y being 1 or
    -1, by Newton's steps on the rows within the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    gram = x @ x.T
    inside = np.ones(len(y), bool)
    beta = np.zeros(len(y))
    for _ in range(30):
        beta[:] = 0
        at = np.flatnonzero(inside)
        beta[at] = np.linalg.solve(gram[np.ix_(at, at)] + np.eye(len(at)) / cost, y[at])
        now = y * (gram @ beta) < 1
        if np.array_equal(now, inside) or not now.any():
            break
        inside = now
    return x.T @ beta


@dataclass
class Machines:
    """One machine for each pair of ``names``, in the order of ``combinations``; weights are buckets
    by machines."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best name and the confidence in it, for each row of vectors."""
        n = len(self.names)
        margins = x @ self.weights + self.bias
        votes = np.zeros((len(x), n))
        for m, (a, b) in zip(margins.T, combinations(range(n), 2)):
            votes[:, a] += (m > 0) + 0.5 * np.tanh(m) / n
            votes[:, b] += (m <= 0) - 0.5 * np.tanh(m) / n
        top, sure = votes.argmax(axis=1), np.ones(len(x))
        for m, (a, b) in zip(margins.T, combinations(range(n), 2)):
            own = np.where(top == a, m, np.where(top == b, -m, np.inf))
            sure = np.minimum(sure, 1 / (1 + np.exp(-np.clip(2 * own, -30, 30))))
        return top, sure


@dataclass
class Model:
    """Machines between families, and those between the languages of each."""

    families: Machines
    within: dict[str, Machines]

    @property
    def languages(self) -> dict[str, list[str]]:
        return {f: m.names for f, m in self.within.items()}

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Best language and confidence for each row of vectors."""
        family, score = self.families.best(x)
        pick = np.full(len(x), "", object)
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                machines = self.within[name]
                top, sure = machines.best(x[rows])
                pick[rows] = np.array(machines.names, object)[top]
                score[rows] *= sure
        return pick.tolist(), score


def _machines(x: np.ndarray, label: np.ndarray, names: list[str]) -> Machines:
    columns = []
    for a, b in combinations(names, 2):
        at = (label == a) | (label == b)
        columns.append(support_vectors(x[at], np.where(label[at] == a, 1.0, -1.0)))
    w = np.array(columns).reshape(len(columns), x.shape[1] + 1)
    return Machines(names, np.ascontiguousarray(w[:, :-1].T, np.float32), w[:, -1])


def fit(docs: DataFrame, usable: str, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Fits on rows of ``docs`` where the SQL condition ``usable`` holds and neither text nor
    language is null; an equal share of ``max_rows`` for each language. Copies of a text with the
    same language are one text; ties are settled by the text's hash, then the text."""
    rows = docs.where(usable).select(F.col(lang_col).alias("_llm_lang"), F.col(text_col).alias("_llm_text")).dropna()
    texts = rows.groupBy("_llm_lang").agg(F.approx_count_distinct("_llm_text").alias("n"))
    counts = {r["_llm_lang"]: r["n"] for r in texts.orderBy(F.desc("n"), "_llm_lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return Model(Machines([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0)), {})
    quota = max(1, max_rows // len(counts))
    # Of a language with many texts only one in so many is compared, three times what is wanted.
    one_in = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (3 * quota)))))
    learned = rows.where(F.col("_llm_lang").isin(*counts))
    few = learned.where(F.pmod(F.xxhash64("_llm_text"), one_in[F.col("_llm_lang")]) == 0).distinct()
    order = Window.partitionBy("_llm_lang").orderBy(F.xxhash64("_llm_text"), "_llm_text")
    chosen = few.withColumn("_llm_rank", F.row_number().over(order)).where(F.col("_llm_rank") <= quota)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in _text.slices(batches, "_llm_text", 1 << 19):
            has = pa.array(lettered(t))
            for first, x in vectors(t):
                own = batch.slice(first, len(x))
                yield pa.record_batch([own.column("_llm_lang"), has.slice(first, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "has", "x"])

    held = settle(chosen.select("_llm_lang", "_llm_text").mapInArrow(run, "lang string, has boolean, x binary")).where("has").toArrow()
    lang = np.array(held["lang"].to_pylist(), object)
    x = np.array([np.frombuffer(r, np.float32) for r in held["x"].to_pylist()], float).reshape(len(lang), 1 << BITS)
    order = np.lexsort([[r.tobytes() for r in x], lang.astype(str)]) if len(lang) else []
    lang, x = lang[order], x[order] * 10
    others = grouped({c: x[lang == c].mean(axis=0) for c in sorted(set(lang)) if family_of(c) is None})
    family = np.array([family_of(c) or others[c] for c in lang], object)
    names = sorted(set(family))
    between = _machines(x, family, names)
    within = {f: _machines(x[family == f], lang[family == f], sorted(set(lang[family == f]))) for f in names}
    for machines in (between, *within.values()):
        machines.weights *= 10  # as the vectors were
    return Model(between, within)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, lang_pred and score of every row; ``und`` with score 0 for a text that is null or has no
    letter, or where no language was learned. Of names with equal votes the first by name is told.
    Repeated rows give repeated rows, an empty table gives an empty one, and no other column is
    read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in _text.slices(batches, "_llm_text"):
            has, pick, score = lettered(t) & bool(model.within), [], []
            for _, x in vectors(t) if model.within else ():
                some, sure = model.decide(x)
                pick += some
                score.append(sure)
            pick = [p if h else UNKNOWN for p, h in zip(pick or has, has)]
            scores = np.where(has, np.concatenate(score) if score else 0.0, 0.0)
            yield pa.record_batch([batch.column("_llm_id"), pa.array(pick, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    ids = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"))
    return picked.mapInArrow(run, f"id {ids}, lang_pred string, score double").withColumnRenamed("id", id_col)
