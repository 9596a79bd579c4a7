"""Exact dedup by content-defined chunk recipes.

A rolling hash cuts each text into chunks whose boundaries move with the content; the text's recipe
is the ordered list of its chunks' identifiers. An identifier is a digest that has been verified: the
chunks travel once, meet by their bytes, and a digest that stands for two different byte strings is
found by counting. Texts are equal when their recipes are; what is compared and shuffled after that
is 16 bytes a chunk. Recipes with an unverified digest, if any, are settled by the texts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm._scratch import settle

ROLLED = 24
AVERAGE = 4096
LEAST = 1024
MOST = 32768


class Cutter:
    """Cuts texts where the hash of the last ``ROLLED`` bytes is small, within the size limits."""

    def __init__(self) -> None:
        self.hasher = _text.Hasher(41)
        self.below = np.uint64((1 << 64) // AVERAGE)

    def chunks(self, t: _text.Texts) -> Iterator[list[bytes]]:
        n = len(t.data)
        marks = np.empty(0, np.int64)
        if n > ROLLED:
            at = np.arange(n - ROLLED + 1)
            marks = np.flatnonzero(self.hasher.of(t.data, at, at + ROLLED) < self.below) + ROLLED
        first = np.searchsorted(marks, t.offsets)
        for i in range(len(t)):
            lo, hi = int(t.offsets[i]), int(t.offsets[i + 1])
            raw, at, out = t.raw(i), 0, []
            for mark in marks[first[i] : first[i + 1]].tolist():
                mark -= lo
                if mark - at < max(LEAST, ROLLED) or mark >= hi - lo:
                    continue
                while mark - at > MOST:
                    out.append(raw[at : at + MOST])
                    at += MOST
                out.append(raw[at:mark])
                at = mark
            while hi - lo - at > MOST:
                out.append(raw[at : at + MOST])
                at += MOST
            if at < len(raw):
                out.append(raw[at:])
            yield out


def _md5(body: bytes) -> bytes:
    return hashlib.md5(body, usedforsecurity=False).digest()


def _native_md5(body: Column) -> Column:
    return F.unhex(F.md5(body))


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = _md5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text, its SHA-256, and the recipe (digests of its chunks in a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch, t in _text.slices(batches, "_llm_text"):
            made, sums = [], []
            for i, own in enumerate(cutter.chunks(t)):
                made.append(b"".join(map(digest, own)))
                sums.append(hashlib.sha256(t.raw(i)).hexdigest())
            yield pa.record_batch([batch.column("_llm_id"), pa.array(sums), pa.array(made, pa.binary()), batch.column("_llm_text")], names=["id", "sha256", "recipe", "text"])

    ids = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_llm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_llm_text"))
    return picked.mapInArrow(run, f"id {ids}, sha256 string, recipe binary, text string")


def ambiguous(docs: DataFrame, native: Callable[[Column], Column] = _native_md5, text_col: str = "text") -> DataFrame:
    """Digests that stand for more than one byte string, over all chunks of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for _, t in _text.slices(batches, "_llm_text"):
            yield pa.record_batch([pa.array({c: None for own in cutter.chunks(t) for c in own}.keys(), pa.binary())], names=["body"])

    bodies = docs.select(F.col(text_col).alias("_llm_text")).mapInArrow(run, "body binary").distinct()
    return bodies.groupBy(native(F.col("body")).alias("digest")).count().where("count > 1").select("digest")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[bytes], bytes] = _md5, native: Callable[[Column], Column] = _native_md5, digest_bytes: int = 16,
) -> DataFrame:
    """Per row: the id, keep_id (largest id of equal texts), group_size, kept, and text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Null ids rank below all
    others. Of rows that are equal in id as well, one is kept. An empty table gives an empty one;
    other columns are not read."""
    made = recipes(docs, digest, id_col, text_col)
    keyed = settle(made.select("id", "sha256", "recipe", F.monotonically_increasing_id().alias("row")))
    doubtful = settle(ambiguous(docs, native, text_col))
    if not doubtful.isEmpty():
        n = F.length("recipe") / F.lit(digest_bytes)
        pieces = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substring(F.col("recipe"), (i - 1) * digest_bytes + 1, F.lit(digest_bytes)))
        listed = keyed.select("recipe").distinct().where(F.length("recipe") > 0).select("recipe", F.explode(pieces).alias("digest"))
        flagged = listed.join(doubtful, "digest", "left_semi").select("recipe").distinct()
        by_text = made.join(flagged, "recipe", "left_semi").select("id", "sha256", F.encode("text", "UTF-8").alias("recipe"))
        by_text = by_text.withColumn("row", F.monotonically_increasing_id()).withColumn("how", F.lit(1))
        keyed = settle(keyed.join(flagged, "recipe", "left_anti").select("id", "sha256", "recipe", "row").withColumn("how", F.lit(0)).unionByName(by_text))
    else:
        keyed = keyed.withColumn("how", F.lit(0))
    groups = keyed.groupBy("how", "recipe").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    out = keyed.join(groups, ["how", "recipe"])
    return out.select(F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), F.col("sha256").alias("text_sha256"))
