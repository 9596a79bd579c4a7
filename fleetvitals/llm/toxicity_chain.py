"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each is a linear (logistic) model over the presence of
informative words, a few measures of form, and the probabilities of the categories before it; in
training those probabilities are out-of-fold, so a later model sees them as it will at prediction.

The models are fitted on at most ``max_rows`` labelled documents, those with the smallest hash of
their id; words are counted by Spark over that sample, and what reaches the driver is bounded by
``max_rows`` times ``max_words`` bits. Prediction covers every whole text and has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm._scratch import settle

MAX_ROWS = 8_000
MAX_WORDS = 400
MIN_DOCUMENTS = 4
MIN_Z = 4.0
FOLDS = 5
RIDGE = 0.1
THRESHOLD = 0.5

_KINDS = [bytes(range(48, 58)), bytes(range(65, 91)), b"\n", b" ", b"#$%&*", b"|"]


def _hasher() -> _text.Hasher:
    return _text.Hasher(71, _text.LOWER)


def _form(t: _text.Texts, n_words: np.ndarray) -> np.ndarray:
    """Share of digits, capitals, line feeds, blanks, signs and bars in a text, and its log length."""
    size = np.maximum(np.diff(t.offsets), 1)
    columns = [np.log1p(n_words) / 10]
    for kind in _KINDS:
        marks = np.zeros(256, bool)
        marks[list(kind)] = True
        seen = np.concatenate([[0], np.cumsum(marks[t.data], dtype=np.int64)])
        columns.append((seen[t.offsets[1:]] - seen[t.offsets[:-1]]) / size)
    return np.column_stack(columns)


@dataclass
class Model:
    """Sorted word hashes; for each category its name, weights (words, form, earlier ones) and bias."""

    words: np.ndarray
    names: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def present(self, t: _text.Texts, hasher: _text.Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of (text, word number), each once, and the form."""
        w = _text.words(t, _text.ALNUM)
        form = _form(t, w.counts)
        t = _text.latin_folded(t)
        if not len(w) or not len(self.words):
            none = np.empty(0, np.int64)
            return none, none, form
        h = hasher.of(t.data, w.start, w.end)
        seen = np.zeros(1 << 16, bool)
        seen[self.words >> np.uint64(48)] = True
        at = np.flatnonzero(seen[h >> np.uint64(48)])
        place = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        hit = self.words[place] == h[at]
        text = np.searchsorted(w.first, at[hit], "right") - 1
        both = np.unique(text * len(self.words) + place[hit])
        return both // len(self.words), both % len(self.words), form

    def chain(self, text: np.ndarray, word: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category, each fed with the ones before."""
        n, k = len(form), len(self.words)
        found = np.zeros((n, 0))
        for weights, bias in zip(self.weights, self.biases):
            z = bias + np.bincount(text, weights[:k][word], n) + form @ weights[k : k + form.shape[1]]
            z += found @ weights[k + form.shape[1] :]
            found = np.column_stack([found, _sigmoid(z)])
        return found


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's steps; a constant where there is one class only."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), (30.0 if len(y) and y[0] else -30.0)
    one = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(one.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(one.shape[1])

    def loss(w: np.ndarray) -> float:
        z = one @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(25):
        p = _sigmoid(one @ w)
        slope = one.T @ (p - y) + penalty * w
        curve = (one.T * np.maximum(p * (1 - p), 1e-9)) @ one + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        rate = 1.0
        while (then := loss(w - rate * step)) > now and rate > 1e-4:
            rate /= 2
        w, before, now = w - rate * step, now, then
        if before - now < 1e-6 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def fit_chain(x: np.ndarray, targets: list[tuple[str, np.ndarray]], fold: np.ndarray) -> tuple[list[str], list[np.ndarray], list[float]]:
    """Fits the categories in order, passing on out-of-fold probabilities."""
    names, weights, biases = [], [], []
    for name, y in targets:
        out = np.zeros(len(y))
        for f in np.unique(fold):
            w, b = _logistic(x[fold != f], y[fold != f])
            out[fold == f] = _sigmoid(x[fold == f] @ w + b)
        w, b = _logistic(x, y)
        names.append(name)
        weights.append(w)
        biases.append(b)
        x = np.column_stack([x, out])
    return names, weights, biases


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """A chain over ``categories``: name to SQL condition on the columns of ``labels``.

    Labels with a null id, or a null in a condition, are left out; several labels of one id count
    as positive if any is. Without usable labels every probability is 0."""
    flags = {name: f"_llm_y{i}" for i, name in enumerate(categories)}
    marked = labels.select(F.col("doc_id").alias("_llm_id"), *(F.expr(c).cast("int").alias(flags[n]) for n, c in categories.items())).dropna()
    labelled = marked.groupBy("_llm_id").agg(*(F.max(f).alias(f) for f in flags.values()))
    # Few more than are wanted are compared, however many labels there are.
    one_in = F.pmod(F.xxhash64("_llm_id"), F.lit(max(1, labelled.count() // max_rows)))
    chosen = labelled.where(one_in == 0).orderBy(F.xxhash64("_llm_id"), "_llm_id").limit(max_rows)
    rows = (
        docs.select(F.col("doc_id").alias("_llm_id"), F.coalesce(F.col("text"), F.lit("")).alias("_llm_text"))
        .join(F.broadcast(chosen), "_llm_id")  # at most max_rows rows of a few numbers
        .groupBy("_llm_id", *flags.values()).agg(F.min_by("_llm_text", F.xxhash64("_llm_text")).alias("_llm_text"))
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch, t in _text.slices(batches, "_llm_text"):
            w = _text.words(t, _text.ALNUM)
            h = hasher.of(_text.latin_folded(t).data, w.start, w.end).view(np.int64)
            own = [np.unique(h[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
            yield pa.record_batch(
                [batch.column("_llm_fold"), *(batch.column(f) for f in flags.values()), pa.array(own, pa.list_(pa.int64())), pa.array(list(_form(t, w.counts)), pa.list_(pa.float64()))],
                names=["_llm_fold", *flags.values(), "words", "form"],
            )

    ddl = f"_llm_fold bigint, {', '.join(f'{f} int' for f in flags.values())}, words array<bigint>, form array<double>"
    folded = rows.withColumn("_llm_fold", F.pmod(F.xxhash64("_llm_id", F.lit("fold")), F.lit(FOLDS)))
    sample = settle(folded.select("_llm_fold", *flags.values(), "_llm_text").mapInArrow(features, ddl))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in flags.values())).first()
    if not totals["n"]:
        return Model(np.empty(0, np.uint64), list(categories), [np.zeros(len(_KINDS) + 1 + i) for i in range(len(categories))], [-30.0] * len(categories))

    by_word = sample.select(F.explode("words").alias("word"), *flags.values()).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in flags.values()))
    z = []
    for f in flags.values():
        rate = totals[f] / totals["n"]
        z.append(F.abs(F.col(f) - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9)))
    strong = by_word.where(F.col("n") >= MIN_DOCUMENTS).withColumn("z", F.greatest(*z, F.lit(0.0))).where(F.col("z") >= MIN_Z)
    picked = strong.orderBy(F.desc("z"), "word").limit(max_words).select("word").toArrow()
    model = Model(np.sort(np.array(picked["word"].to_pylist(), np.int64).view(np.uint64)))

    known = model.words.view(np.int64)
    held = sample.select("_llm_fold", *flags.values(), F.array_intersect("words", F.array(*map(F.lit, known.tolist())).cast("array<bigint>")).alias("words"), "form").toArrow()
    y = {n: np.array(held[f].to_pylist(), float) for n, f in flags.items()}
    form = np.array(held["form"].to_pylist(), float)
    x = np.zeros((len(form), len(known) + form.shape[1]))
    x[:, len(known) :] = form
    number = {h: i for i, h in enumerate(known.tolist())}
    for i, own in enumerate(held["words"].to_pylist()):
        x[i, [number[h] for h in own]] = 1
    fold = np.array(held["_llm_fold"].to_pylist())
    order = np.lexsort([*x.T[::-1], fold])  # the order in which rows arrive must not matter
    model.names, model.weights, model.biases = fit_chain(x[order], [(n, y[n][order]) for n in categories], fold[order])
    return model


def probabilities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and one column ``p_<category>`` per row of ``docs``, in their order.

    Null and empty texts are told by their form alone; null ids stay null, repeated rows are answered
    one by one and alike, an empty table gives an empty one, and other columns, whatever their names,
    are not read. Texts of any length are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch, t in _text.slices(batches, "_llm_text"):
            p = model.chain(*model.present(t, hasher))
            yield pa.record_batch([batch.column("_llm_id"), *(pa.array(c) for c in p.T)], names=["id", *(f"p_{n}" for n in model.names)])

    ids = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"))
    return picked.mapInArrow(run, f"id {ids}, " + ", ".join(f"`p_{n}` double" for n in model.names)).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, category: str, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose probability is below the threshold.

    A probability that equals the threshold goes. Null and empty texts are judged like others (by
    their form alone), repeated rows stay or go together, an empty table gives an empty one, and extra
    columns pass through whatever their names."""
    at, column = model.names.index(category), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, t in _text.slices(iter([named]), f"c{column}"):
                p = model.chain(*model.present(t, hasher))[:, at]
                yield part.filter(pa.array(p < threshold)).rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
