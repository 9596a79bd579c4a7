"""Line dedup by content-defined chunks.

A line ends at a line feed, after punctuation, and at content-defined words, so that a passage gives
the same lines wherever it stands. A hash rolls over the hashes of two lines in a row; a line end
whose value is the least of any ``WINDOW`` words in a row ends a chunk; where they hold no line end,
their least word does. What lies around a passage can
move a boundary only before the first and after the last of its own. Chunks are put together to
multi-line chunks of ``CHUNK_WORDS`` words at least; the first place that holds one, by (id, place),
keeps it.

The keeper is asked for its words around the chunk. Equality is a comparison of their bytes, word by
word, and extends to both sides of the chunk. What goes are runs of ``PASSAGE_WORDS`` words or more, to
the word, of which every word lies in ``PIECE_WORDS`` words or more that an earlier place has as well;
a passage that was quoted in pieces before is found by its pieces. A passage of ``PASSAGE_WORDS`` has
a chunk that all its places share as long as its first two lines have no more than nine words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm._scratch import settle

#: Least words of what is removed, and of each piece of it that some keeper has.
PASSAGE_WORDS = 50
PIECE_WORDS = 16
#: Words of which one line end becomes a boundary (a power of two), and least words of a chunk.
WINDOW = 16
CHUNK_WORDS = 10
#: Words whose mixed bytes are 0 in so many low bits end a line too: every other word.
LINE_BITS = 1
#: Words beyond the outer chunks that are compared.
BEYOND = 64
#: Chunks with more than one in so many of all places are met without a shuffle; there are no more of them.
HEAVY = 1000

_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True


class Chunks:
    """Chunks of several texts: trimmed byte range, words; ``first[i]`` is text i's first."""

    def __init__(self, t: _text.Texts, hasher: _text.Hasher) -> None:
        w = _text.words(t, _text.SOLID)
        n = len(w)
        if not n:
            none = np.empty(0, np.int64)
            self.start = self.end = self.words = none
            self.first = np.zeros(len(t.offsets), np.int64)
            return
        feeds = np.concatenate([[0], np.cumsum(t.data == 10, dtype=np.int32)])
        closes = _CLOSING[t.data[w.end - 1]]
        closes[:-1] |= feeds[w.start[1:]] != feeds[w.end[:-1]]
        a, z = t.data[w.start].astype(np.uint32), t.data[w.end - 1].astype(np.uint32)
        size = (w.end - w.start).astype(np.uint32)
        middle = t.data[(w.start + w.end) // 2].astype(np.uint32)
        mark = (a * 31 + z * 7 + middle * 131 + size * 17) * np.uint32(2654435761)
        closes |= mark >> np.uint32(32 - LONG_LINE_BITS) == 0
        closes[w.first[1:][w.counts > 0] - 1] = True
        line_end = np.flatnonzero(closes)
        line_first = np.concatenate([[0], line_end[:-1] + 1])
        lines = np.searchsorted(line_first, w.first)
        h = hasher.of(t.data, w.start[line_first], w.end[line_end])
        before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
        own = np.diff(lines) > 0
        before[lines[:-1][own]] = 0
        ends = _text.mixed(before * np.uint64(0x9E3779B97F4A7C15) + h) < ENDS_BELOW
        ends[lines[1:][own] - 1] = True
        last = np.flatnonzero(ends)
        begin = np.concatenate([[0], last[:-1] + 1])
        self.start, self.end = w.start[line_first[begin]], w.end[line_end[last]]
        self.words = line_end[last] - line_first[begin] + 1
        self.first = np.searchsorted(begin, lines)


def _hasher() -> _text.Hasher:
    return _text.Hasher(101)


class Runs:
    """Hashes of runs of words, from prefix sums over the hashes of the words."""

    def __init__(self, words: np.ndarray) -> None:
        base = (int(_text._odd(102, 1)[0]) & ~3) | 3
        up = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words), b, np.uint64))])
        self.inverses = up(pow(base, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up(base)[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _text.mixed((self.sums[end] - self.sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def _least(value: np.ndarray, over: Callable = np.minimum) -> np.ndarray:
    """The least of ``WINDOW`` values from each place on, by doubling."""
    step = 1
    while step < WINDOW:
        value = over(value[:-step], value[step:])
        step *= 2
    return value


def line_ends(t: _text.Texts, w: _text.Words) -> np.ndarray:
    """Numbers of the words that end a line; the last word of a text does."""
    feeds = np.concatenate([[0], np.cumsum(t.data == 10, dtype=np.int32)])
    closes = _CLOSING[t.data[w.end - 1]]
    closes[:-1] |= feeds[w.start[1:]] != feeds[w.end[:-1]]
    a, z = t.data[w.start].astype(np.uint32), t.data[w.end - 1].astype(np.uint32)
    size = (w.end - w.start).astype(np.uint32)
    middle = t.data[(w.start + w.end) // 2].astype(np.uint32)
    mark = (a * 31 + z * 7 + middle * 131 + size * 17) * np.uint32(2654435761)
    closes |= mark >> np.uint32(32 - LINE_BITS) == 0
    closes[w.first[1:][w.counts > 0] - 1] = True
    return np.flatnonzero(closes)


def chunks(t: _text.Texts, hasher: _text.Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word number in it and hash of each multi-line chunk."""
    w = _text.words(t, _text.SOLID)
    n = len(w) - WINDOW + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, np.empty(0, np.uint64)
    runs = Runs(hasher.of(t.data, w.start, w.end))
    text = w.text_of()
    end = line_ends(t, w)
    first = np.concatenate([[0], end[:-1] + 1])
    lines = runs.of(first, end + 1)
    before = np.concatenate([np.zeros(1, np.uint64), lines[:-1]])
    before[1:][text[end[1:]] != text[end[:-1]]] = 0
    # Words come after all line ends; they count where a window has no line end.
    value = (runs.of(np.arange(len(w)), np.arange(len(w)) + 1) >> np.uint64(1)) | np.uint64(1 << 63)
    value[end] = _text.mixed(before * np.uint64(0x9E3779B97F4A7C15) + lines) >> np.uint64(1)
    # A place is chosen if it is the least of some window that lies in its text.
    least = _least(value)
    least[text[:n] != text[WINDOW - 1 :]] = 0
    edge = np.zeros(WINDOW - 1, np.uint64)
    cut = np.flatnonzero(_least(np.concatenate([edge, least, edge]), np.maximum) == value)
    begin, of = cut + 1, text[cut]
    # The nearest boundary behind that is far enough away, if it is in the same text.
    last = np.searchsorted(cut, cut + CHUNK_WORDS)
    whole = last < len(cut)
    whole[whole] = of[last[whole]] == of[whole]
    begin, of, to = begin[whole], of[whole], cut[last[whole]] + 1
    return of, begin - w.first[of], runs.of(begin, to)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Id and text hash name a row; equal rows are one document here. Should two texts of one id
    share a hash, words still are compared, so nothing goes that is no repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("_llm_id"), F.xxhash64(text).alias("_llm_hash")]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])).rstrip()


def _applied(docs: DataFrame, lists: DataFrame, cut: Callable, id_col: str, text_col: str, detail: bool) -> DataFrame:
    """``docs`` after ``cut``, which gives for each text with an entry in ``lists`` what is left, the
    words removed and the spans removed."""
    column = docs.columns.index(text_col)
    plain = docs.select("*", *_keyed(docs, id_col, text_col))
    on = plain["_llm_id"].eqNullSafe(lists["_llm_id"]) & (plain["_llm_hash"] == lists["_llm_hash"])
    joined = plain.join(lists, on, "left").select(*(plain[c] for c in docs.columns), lists["_llm_repeats"])
    counted = "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("bigint", "int")
    size_at = docs.columns.index("n_chars") if counted else -1
    id_at = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, t in _text.slices(iter([named]), f"c{column}"):
                entries = part.column(part.num_columns - 1)
                touched = np.flatnonzero(entries.is_valid().to_numpy(zero_copy_only=False))
                some = part.take(pa.array(touched))
                done = cut(_text.texts(some.column(f"c{column}")), some.column(some.num_columns - 1).to_pylist())
                changed = {i: (x[0].decode("utf-8", "replace"), *x[1:]) for i, x in zip(touched.tolist(), done) if x[2]}
                columns = list(part.columns[:-1])
                if detail or changed:
                    columns[column] = _put(columns[column], {i: x[0] for i, x in changed.items()})
                if counted and changed:
                    columns[size_at] = _put(columns[size_at], {i: len(x[0]) for i, x in changed.items()})
                if not detail:
                    yield pa.record_batch(columns, names=batch.schema.names[:-1])
                    continue
                gone, spans = np.zeros(len(t), np.int64), [[] for _ in range(len(t))]
                for i, x in changed.items():
                    gone[i], spans[i] = x[1], [{"start": a, "end": b} for a, b in x[2]]
                yield pa.record_batch([columns[id_at], columns[column], pa.array(gone), pa.array(spans, _SPANS)], names=["id", "text", "removed_words", "spans"])

    if detail:
        ids = docs.schema[id_col].dataType.simpleString()
        return joined.mapInArrow(run, f"id {ids}, text string, removed_words bigint, spans array<struct<start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
    return joined.mapInArrow(run, docs.schema)


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per multi-line chunk: id, text hash, word number, hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch, t in _text.slices(batches, "_llm_text"):
            row, word, key = chunks(t, hasher)
            columns = [batch.column("_llm_id").take(pa.array(row)), batch.column("_llm_hash").take(pa.array(row)), pa.array(word.astype(np.int32)), pa.array(key.view(np.int64))]
            yield pa.record_batch(columns, names=["_llm_id", "_llm_hash", "word", "key"])

    ids = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(*_keyed(docs, id_col, text_col), F.col(text_col).alias("_llm_text"))
    return picked.mapInArrow(run, f"_llm_id {ids}, _llm_hash bigint, word int, key bigint")


def regions(row: np.ndarray, keeper: np.ndarray, word: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of several documents put together: their order, and where each region begins in it.

    Given are a chunk's document, the number of its keeper, its word and the keeper's word. Chunks of
    one keeper at one shift are a region as long as the words beyond them touch. Of one word or phrase
    over and over, which has one place of its keeper in a row, a chunk in ``WINDOW`` words is enough."""
    order = np.lexsort([kept, keeper, word, row])
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (row, keeper, kept, word // WINDOW):
        same &= x[order][1:] == x[order][:-1]
    order = order[np.concatenate([np.ones(min(1, len(order)), bool), ~same])]
    order = order[np.lexsort([word[order], (word - kept)[order], keeper[order], row[order]])]
    new = np.diff(word[order]) > 2 * BEYOND
    for x in (row, keeper, word - kept):
        new |= x[order][1:] != x[order][:-1]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), new]))


def _repeated(found: DataFrame) -> DataFrame:
    """Chunks whose first place is another one, with that ``kept`` place.

    Every place finds the chunk's first one by its hash. The few chunks that hold more than one in
    ``HEAVY`` of all repeated places, no more than ``HEAVY`` by number, are met by broadcast, so a line
    that a third of all documents share is no single task."""
    found, place = settle(found), F.struct("_llm_id", "_llm_hash", "word")
    kept = settle(found.groupBy("key").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    all_places = kept.agg(F.sum("n")).first()[0] or 0
    heavy = kept.where(F.col("n") * HEAVY > all_places).select("key", F.col("kept").alias("_heavy"))
    light = kept.where(F.col("n") * HEAVY <= all_places).select(F.col("key").alias("_key"), "kept")
    met = found.join(F.broadcast(heavy), "key", "left")
    # Places of heavy chunks go anywhere: their key in the next join is any number, and not looked at.
    met = met.withColumn("_key", F.when(F.col("_heavy").isNull(), F.col("key")).otherwise(F.xxhash64("_llm_hash", "word")))
    both = met.join(light, "_key", "left").withColumn("kept", F.coalesce("_heavy", "kept"))
    return both.where(F.col("kept").isNotNull() & ~place.eqNullSafe(F.col("kept"))).select("_llm_id", "_llm_hash", "word", "kept")


def _asks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What each document asks of which keeper: the shift, its own chunks and the keeper's first and
    last one."""
    seed = F.struct("word", F.col("kept._llm_id").alias("keeper"), F.col("kept._llm_hash").alias("keeper_hash"), F.col("kept.word").alias("kept"))
    seeds = _repeated(chunk_rows(docs, id_col, text_col)).groupBy("_llm_id", "_llm_hash").agg(F.collect_list(seed).alias("seeds"))
    ids = docs.schema[id_col].dataType.simpleString()
    names = ["_llm_id", "_llm_hash", "keeper", "keeper_hash", "first", "last", "shift", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("seeds").cast(pa.large_list(batch.schema.field("seeds").type.value_type))
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = dict(zip(("word", "keeper", "hash", "kept"), lists.flatten().flatten()))
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            word, kept, text = (flat[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("word", "kept", "hash"))
            ids = flat["keeper"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keeper = np.unique(np.stack([ids, text]), axis=1, return_inverse=True)[1].ravel()
            order, begin = regions(row, keeper, word, kept)
            first, last, shift = order[begin], order[np.append(begin[1:], len(order)) - 1], (word - kept)[order[begin]]
            told = [flat["keeper"].take(pa.array(first)), pa.array(text[first]), *(pa.array(x.astype(np.int32)) for x in (word[first] - shift, word[last] - shift, shift))]
            words = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), pa.array(word[order].astype(np.int32)))
            own = batch.select(["_llm_id", "_llm_hash"]).take(pa.array(row[first]))
            yield pa.record_batch([*own.columns, *told, words], names=names)

    return seeds.mapInArrow(run, f"_llm_id {ids}, _llm_hash bigint, keeper {ids}, keeper_hash bigint, first int, last int, shift int, words array<int>")


def _copies(docs: DataFrame, asks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The words that are asked for, each stretch once: ``BEYOND`` words more on both sides."""
    wanted = asks.groupBy("keeper", "keeper_hash").agg(F.collect_set(F.struct("first", "last")).alias("asked"))
    # All columns go along, so that Spark shuffles the texts once for this join and for the last one.
    plain = docs.select("*", *_keyed(docs, id_col, text_col))
    column = docs.columns.index(text_col)
    on = plain["_llm_id"].eqNullSafe(wanted["keeper"]) & (plain["_llm_hash"] == wanted["keeper_hash"])
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns - 3)] + ["keeper", "keeper_hash", "asked"])
            for part, t in _text.slices(iter([named]), f"c{column}"):
                w, view = _text.words(t, _text.SOLID), t.data.tobytes()
                rows, out = [], []
                for i, asked in enumerate(part.column("asked").to_pylist()):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    for one in asked:
                        a, b = lo + max(0, one["first"] - BEYOND), min(hi, lo + one["last"] + CHUNK_WORDS + BEYOND)
                        if a < b:
                            rows.append(i)
                            out.append((one["first"], one["last"], view[w.start[a] : w.end[b - 1]]))
                own = part.select(["keeper", "keeper_hash"]).take(pa.array(rows, pa.int64()))
                columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.record_batch([*own.columns, *columns], names=["keeper", "keeper_hash", "first", "last", "copy"])

    found = plain.join(wanted, on).select(*(plain[c] for c in docs.columns), *(wanted[c] for c in ("keeper", "keeper_hash", "asked")))
    found = found.mapInArrow(run, f"keeper {ids}, keeper_hash bigint, first int, last int, copy binary")
    return found.groupBy("keeper", "keeper_hash", "first", "last").agg(F.min("copy").alias("copy"))  # equal rows tell the same


def matched(own: list[bytes], entries: list[dict], least: int = PASSAGE_WORDS, piece: int = PIECE_WORDS) -> np.ndarray:
    """Which words go: those of runs of ``least`` words, all in ``piece`` words that a keeper has as
    well, word for word."""
    gone = np.zeros(len(own) + 2, bool)
    for e in entries:
        copy, done = e["copy"].split(), 0
        back = e["shift"] + max(0, e["first"] - BEYOND)  # own word number less number in the copy
        low, high = max(0, back), min(len(own), len(copy) + back)
        for word in sorted(e["words"]):
            a = b = word
            if word < done or not low <= word < high:
                continue
            while b < high and own[b] == copy[b - back]:
                b += 1
            while a > low and own[a - 1] == copy[a - 1 - back]:
                a -= 1
            done = b
            if b - a >= piece:
                gone[a + 1 : b + 1] = True
    edges = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
    out = np.zeros(len(own), bool)
    for a, b in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
        out[a:b] = True
    return out


def line_dedup(docs: DataFrame, least: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """``docs`` with repeated passages of ``least`` words or more taken out of the text, from their
    first word to their last; all other columns as they are, but ``n_chars`` counts what is left.

    With ``detail`` the result is instead id, text, removed_words and the byte spans removed from the
    text. Texts without repeats are returned untouched, null texts stay null, and a text that is a
    repeat from end to end becomes empty. The place with the smallest id, then text hash, then word
    stays; null ids come first. Rows equal in id and text are one document: they do not remove each
    other. Empty tables give empty ones. What is asked for is written down."""
    asks = settle(_asks(docs, id_col, text_col))
    copies = _copies(docs, asks, id_col, text_col)
    on = asks["keeper"].eqNullSafe(copies["keeper"])
    for c in ("keeper_hash", "first", "last"):
        on &= asks[c] == copies[c]
    entry = F.struct(asks["first"], asks["shift"], asks["words"], copies["copy"])
    lists = asks.join(copies, on).groupBy("_llm_id", "_llm_hash").agg(F.collect_list(entry).alias("_llm_repeats"))

    def cut(t: _text.Texts, lists: list) -> list[tuple[bytes, int, list[tuple[int, int]]]]:
        w, out = _text.words(t, _text.SOLID), []
        for i, entries in enumerate(lists):
            text, start = t.raw(i), w.start[w.first[i] : w.first[i + 1]] - t.offsets[i]
            gone = matched(text.split(), entries, least)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            bounds = np.append(start, len(text))[edges].tolist()
            spans = list(zip(bounds[::2], bounds[1::2]))
            out.append((_without(text, spans), int(gone.sum()), spans))
        return out

    return _applied(docs, lists, cut, id_col, text_col, detail)


def _put(column: pa.Array, values: dict) -> pa.Array:
    if not values:
        return column
    out = column.to_pylist()
    for i, x in values.items():
        out[i] = x
    return pa.array(out, column.type)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
