"""Training-order materialisation of token ids.

Every text is tokenised and cut into sequences of fixed length. A sequence's number is a hash of its
row's id and text and of its place in the text, so it comes from the data alone, however the table is
split or read again. A keyed Feistel network with cycle-walking permutes the numbers below
``NUMBERS``; their order is the training order. Equal ranges of permuted numbers are the shards: rows
are shuffled once to their shard, sorted and written as records of one fixed stride. The count of
each shard then gives its first global slot, so slot s lies in the shard whose range holds it, at
byte (s - first slot) * stride, and reading can start or resume anywhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm import _text, _tokens
from fleetvitals.llm._scratch import settle, shared_folder
from fleetvitals.llm.warc_zst import _file_system

LENGTH = 512
END_ID = 1
ROUNDS = 6
SHARD_BYTES = 32 << 20
#: Numbers lie below this; with 62 bits, two different sequences seldom share one, and then keep the
#: order of their ids.
NUMBERS = 3 << 60


class Feistel:
    """A keyed permutation of 0 to n - 1, and its inverse, on arrays.

    The network works on the least even number of bits that hold n; a value beyond n goes through it
    again until it falls inside."""

    def __init__(self, n: int, key: bytes) -> None:
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        words = hashlib.blake2b(key, digest_size=8 * ROUNDS).digest()
        self.keys = np.frombuffer(words, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        return _text.mixed(x * np.uint64(0x9E3779B97F4A7C15) ^ key) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x

    def permute(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def invert(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def _id_type(tokenizer: str) -> np.dtype:
    size = _tokens.encoder(tokenizer).tokenizer.get_vocab_size()
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def numbers(names: np.ndarray, again: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of sequences, from the names of their rows, how often a row of that name was met before, and
    their places in the text."""
    steps = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + again.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _text.mixed(names.view(np.uint64) + steps) % np.uint64(NUMBERS)


def sequences(docs: DataFrame, tokenizer: str, key: bytes, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids, order) per sequence."""
    name = F.xxhash64(F.col(id_col).cast("string"), F.lit("/"), text_col).alias("_llm_name")
    picked = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = _tokens.encoder(tokenizer), _id_type(tokenizer)
        shuffle, met = Feistel(NUMBERS, key), Counter()
        for batch, t in _text.slices(batches, "_llm_text"):
            ids, offsets = encoder.encode(t)
            names = batch.column("_llm_name").to_numpy()
            row, start, length, again, kept = [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = np.append(ids[lo:hi], np.uint32(END_ID)).astype(kind)
                before = met[int(names[i])]
                met[int(names[i])] += 1
                for at in range(0, len(own), LENGTH):
                    piece = own[at : at + LENGTH]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    again.append(before)
                    kept.append(piece.tobytes())
            number = numbers(names[row], np.array(again, np.int64), np.array(start, np.int64) // LENGTH)
            yield pa.record_batch(
                [batch.column("_llm_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(kept, pa.binary()), pa.array(shuffle.permute(number).astype(np.int64))],
                names=["id", "start", "length", "ids", "order"],
            )
        encoder.forget()

    ids = docs.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"id {ids}, start bigint, length bigint, ids binary, `order` bigint")


def write_shards(
    docs: DataFrame, tokenizer: str, key: bytes = b"epoch 0", folder: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, str]:
    """Writes the shards; returns their index and the folder.

    The same rows and key give the same slots, whatever the splits; only rows that are equal in id and
    text, and so have the same records, are told apart by how many of them a task has met.

    The index has one row per sequence: id, start (ids of its text before it), length, shard,
    record, slot, and the path of its shard. A record is its length and then its ids, padded with
    zeros; both are little-endian and of 16 bits where the vocabulary allows. A null or empty text is
    its end id alone; repeated rows and repeated or null ids are sequences of their own."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = sequences(docs, tokenizer, key, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.least((F.col("order") / F.lit(float(NUMBERS)) * F.lit(shards)).cast("int"), F.lit(shards - 1))
    dealt = rows.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order", "id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = _id_type(tokenizer)
        files, top = _file_system(folder)
        attempt, out, now, path, count = TaskContext.get().taskAttemptId(), None, None, "", 0
        for batch in batches:
            record, paths = [], []
            for k, ids, n in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), batch.column("length").to_pylist()):
                if k != now:
                    if out is not None:
                        out.close()
                    files.create_dir(top, recursive=True)
                    path = f"shard-{k:06d}-{attempt:08d}.ids"
                    out, now, count = files.open_output_stream(f"{top}/{path}", compression=None), k, 0
                out.write(np.array([n], kind).tobytes() + ids + bytes(kind.itemsize * (LENGTH - n)))
                record.append(count)
                paths.append(path)
                count += 1
            yield pa.record_batch([*(batch.column(c) for c in ("id", "start", "length", "shard")), pa.array(record, pa.int64()), pa.array(paths, pa.string())], names=["id", "start", "length", "shard", "record", "path"])
        if out is not None:
            out.close()

    ids = docs.schema[id_col].dataType.simpleString()
    index = settle(dealt.mapInArrow(run, f"id {ids}, start bigint, length bigint, shard int, record bigint, path string"))
    counts = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    first = counts.select("shard", before.alias("first"))
    slotted = index.join(first, "shard").withColumn("slot", F.col("first") + F.col("record"))
    return slotted.select(F.col("id").alias(id_col), "start", "length", "shard", "record", "slot", "path"), folder


def read_shards(index: DataFrame, folder: str, tokenizer: str, from_slot: int = 0, with_ids: bool = False) -> DataFrame:
    """Slot, length, CRC-32 of the ids (as 32-bit numbers) and, if asked for, the ids of every
    record from ``from_slot`` on, read from the shards in order."""
    shards = index.where(F.col("slot") >= from_slot).groupBy("path").agg(F.min("slot").alias("slot"), F.min("record").alias("record"), F.count(F.lit(1)).alias("n"))

    shards = shards.repartition(max(1, shards.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(tokenizer)
        files, top = _file_system(folder)
        stride = kind.itemsize * (LENGTH + 1)
        for batch in batches:
            for one in batch.to_pylist():
                with files.open_input_file(f"{top}/{one['path']}") as source:
                    source.seek(one["record"] * stride)
                    for at in range(0, one["n"], 4096):
                        n = min(4096, one["n"] - at)
                        data = source.read(n * stride)
                        if len(data) != n * stride:
                            raise ValueError(f"{one['path']} is cut short")
                        table = np.frombuffer(data, kind).reshape(n, LENGTH + 1)
                        pieces = [r[1 : 1 + r[0]].astype("<u4") for r in table]
                        columns = [pa.array(one["slot"] + at + np.arange(n)), pa.array(table[:, 0].astype(np.int64)), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                        yield pa.record_batch(columns, names=["slot", "length", "ids_crc32", "ids"][: len(columns)])

    return shards.mapInArrow(run, "slot bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, key: bytes = b"epoch 0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of the written shards joined with what reading them gives: id, start, length,
    ids_crc32, slot, shard, record."""
    index, folder = write_shards(docs, tokenizer, key, None, id_col, text_col)
    read = read_shards(index, folder, tokenizer)
    both = index.drop("length", "path").join(read.hint("merge"), "slot")  # neither side has a bound
    return both.select(id_col, "start", "length", "ids_crc32", "slot", "shard", "record")
