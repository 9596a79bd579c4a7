"""Packing by best-fit decreasing into fixed windows.

Tokens are made where the text lies; what travels is one small row per piece. A document longer than
a window is first cut into full windows, each a sequence of its own. What is left over is dealt by
row number into groups of bounded size, and in each group the longest piece goes first into the
tightest open window that holds it, which a segment tree indexed by remaining capacity finds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import _text, _tokens
from fleetvitals.llm._scratch import settle

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 10_000


class CapacityTree:
    """Which remaining capacities have an open window; leaf ``size + c`` stands for capacity c."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) with the least capacity of at least ``need``."""
        count, i = self.count, self.size + need
        if not count[i]:
            while i & 1 or not count[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset in it for each length, which must fall."""
    tree, windows, numbers, offsets = CapacityTree(window), 0, [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, windows = (window, windows), windows + 1
        left, number = found
        numbers.append(number)
        offsets.append(window - left)
        if left > n:
            tree.add(left - n, number)
    return numbers, offsets


def tokenized_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids that cover each row's ids and its end id, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.encoder(tokenizer)
        for batch, t in _text.slices(batches, "_llm_text"):
            ids, offsets = encoder.encode(t)
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), window):
                    piece = own[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
                    if with_ids:
                        kept.append(piece)
            columns = [batch.column("_llm_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)
        encoder.forget()
        _text.release()

    ids = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"))
    schema = f"id {ids}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` in the sequence (gapless from 0) and ``padded_to``.

    A sequence is padded to the window unless its length is a power of two. Sequence numbers are
    unique, not dense. Pieces longer than the window are refused. Groups are dealt by a row number
    that is written down first, so any key may repeat without making a group large."""
    numbered = settle(pieces.withColumn("_llm_row", F.monotonically_increasing_id()))
    groups = max(1, -(-numbered.count() // group_rows))
    shape = pieces.schema

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(["length", "_llm_row"], ascending=[False, True], kind="stable")
        lengths = one["length"].tolist()
        if lengths[0] > window:
            raise ValueError("a piece is longer than the window")
        numbers, one["offset"] = best_fit(lengths, window)
        filled = np.bincount(numbers, weights=lengths).astype(np.int64)
        one["sequence_id"] = np.int64(one["_llm_group"].iloc[0]) * (1 << 32) + np.array(numbers, np.int64)
        own = filled[numbers]
        one["padded_to"] = np.where(own & (own - 1) == 0, own, window)
        return one[[*shape.fieldNames(), "sequence_id", "offset", "padded_to"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", sequence_id bigint, `offset` bigint, padded_to bigint"
    return numbered.withColumn("_llm_group", F.pmod("_llm_row", F.lit(groups))).groupBy("_llm_group").applyInPandas(run, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` packed: one output row per piece, with its ids if asked for.

    A null or empty text is its end id alone. Repeated rows and repeated or null ids are packed each
    for itself; an empty table gives no rows; other columns are not read."""
    return pack(tokenized_pieces(docs, tokenizer, window, with_ids=with_ids, id_col=id_col, text_col=text_col), window)
