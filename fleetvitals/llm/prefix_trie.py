"""Prefix trie of conversations: adaptive radix trees over turn ids of fixed width.

A turn becomes 16 big-endian bytes (of the digest of its role and text) where it is read, and a
conversation one byte string, so texts never travel. Equal strings are counted first; then all
distinct ones are dealt by ranges and sorted, and every run of ``BLOCK_KEYS`` becomes one radix tree:
node layouts grow from 4 over 16 and 48 to 256 children, chains of single children are kept as one
compressed path, and only depths that are whole turns emit nodes.

A node that may go on in another block is a prefix of its block's first or last string. These paths,
two a block, are all that blocks have to settle between them: their nodes are added up, and what they
themselves add to their ancestors is summed along each path. Everything else is final in its block.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm._scratch import settle

#: Bytes of a turn's id.
WIDTH = 16
#: A radix tree takes so many different conversations, and so many bytes of them, before the next one begins.
BLOCK_KEYS = 4096
BLOCK_BYTES = 4 << 20
#: Ids of equal conversations travel in strings of up to 2 ** ID_BITS neighbouring numbers.
ID_BITS = 8

_NOBODY = hashlib.sha256(b"").hexdigest()
_PARTS = "node binary, parent binary, chain string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, bytes bigint, ends_sha256 string, loose boolean"


class Few:
    """Up to 4, then 16 children: their bytes in order, beside the nodes."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4) -> None:
        self.bytes, self.nodes, self.room = [], [], room

    def find(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node) -> Few | Indexed:
        if self.find(byte) is None and len(self.nodes) == self.room:
            if self.room == 16:
                return Indexed(self).put(byte, node)
            self.room = 16
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        else:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        return self

    def all(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children: a place for each of the 256 bytes that says where its node is."""

    __slots__ = ("index", "nodes")

    def __init__(self, few: Few) -> None:
        self.index, self.nodes = bytearray(b"\xff" * 256), []
        for byte, node in zip(few.bytes, few.nodes):
            self.put(byte, node)

    def find(self, byte: int) -> Node | None:
        at = self.index[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node: Node) -> Indexed | Full:
        at = self.index[byte]
        if at != 255:
            self.nodes[at] = node
        elif len(self.nodes) == 48:
            return Full(self).put(byte, node)
        else:
            self.index[byte] = len(self.nodes)
            self.nodes.append(node)
        return self

    def all(self) -> list[Node]:
        return [self.nodes[at] for at in self.index if at != 255]


class Full:
    """A child for any byte."""

    __slots__ = ("nodes",)

    def __init__(self, indexed: Indexed) -> None:
        self.nodes = [indexed.find(byte) for byte in range(256)]

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def all(self) -> list[Node]:
        return [node for node in self.nodes if node is not None]


class Node:
    """``path`` follows the byte that led here; ``row`` is the string that ends after it, or -1."""

    __slots__ = ("path", "row", "kids")

    def __init__(self, path: bytes, row: int = -1) -> None:
        self.path, self.row, self.kids = path, row, None

    def put(self, byte: int, node: Node) -> None:
        self.kids = (self.kids or Few()).put(byte, node)


def insert(root: Node, key: bytes, row: int) -> None:
    node, at, above = root, 0, None
    while True:
        path = node.path
        if not key.startswith(path, at):
            same = next((i for i, (a, b) in enumerate(zip(path, key[at : at + len(path)])) if a != b), min(len(path), len(key) - at))
            fork = Node(path[:same])
            byte, node.path = path[same], path[same + 1 :]
            fork.put(byte, node)
            above[0].put(above[1], fork)
            node, path = fork, fork.path
        at += len(path)
        if at == len(key):
            node.row = row
            return
        below = node.kids.find(key[at]) if node.kids else None
        if below is None:
            node.put(key[at], Node(key[at + 1 :], row))
            return
        above, node, at = (node, key[at]), below, at + 1


class Block:
    """One radix tree and the rows it gives.

    ``keys`` ascend and differ; ``sizes`` are the bytes of their turns' texts, ``counts`` and
    ``least`` the number and the smallest id of the conversations that are exactly this key."""

    def __init__(self, most: int = BLOCK_KEYS) -> None:
        self.keys, self.sizes, self.counts, self.least, self.ends = [], [], [], [], []
        self.bytes, self.most = 0, most

    def add(self, key: bytes, sizes: list[int], count: int, least: int, ends: str) -> None:
        for held, value in zip((self.keys, self.sizes, self.counts, self.least, self.ends), (key, sizes, count, least, ends)):
            held.append(value)
        self.bytes += len(key)

    @property
    def full(self) -> bool:
        return len(self.keys) >= self.most or self.bytes >= BLOCK_BYTES

    def rows(self) -> Iterator[tuple]:
        if not self.keys:
            return
        # The root's path stays empty, so that a fork always has a node above it.
        root = Node(b"")
        for row, key in enumerate(self.keys):
            insert(root, key, row)
        # Parents before children, bytes ascending: (node, number of the one above, first byte, end).
        order, todo = [], [(root, -1, 0)]
        while todo:
            node, above, start = todo.pop()
            end = start + len(node.path)
            order.append((node, above, start, end))
            if node.kids:
                todo += [(kid, len(order) - 1, end + 1) for kid in reversed(node.kids.all())]
        many = len(order)
        last = len(self.keys) - 1
        count, least, sample = [0] * many, [None] * many, [-1] * many
        loose = [None] * many  # the chain of a node on the way to the first or last key
        name = hashlib.sha256(self.keys[0]).hexdigest()
        for i in range(many - 1, -1, -1):
            node, above, _, _ = order[i]
            if node.row >= 0:
                count[i] += self.counts[node.row]
                least[i] = self.least[node.row] if least[i] is None else min(least[i], self.least[node.row])
                sample[i] = node.row
                if node.row in (0, last):
                    loose[i] = f"{name}-0" if node.row == 0 else loose[i] or f"{name}-1"
            if above >= 0:
                count[above] += count[i]
                least[above] = least[i] if least[above] is None else min(least[above], least[i])
                sample[above] = sample[i]
                if loose[i]:
                    loose[above] = loose[i] if loose[above] is None else min(loose[above], loose[i])
        # Ids of the whole turns on each node's path, from the top down.
        ids, points, tail = [], [], []
        for node, above, start, end in order:
            i = len(ids)
            key = self.keys[sample[i]]
            first = 0 if above < 0 else (order[above][3] // WIDTH) + 1
            turns = range(first, end // WIDTH + 1)
            at, named = (b"", []) if above < 0 else (tail[above], [])
            for t in turns:
                at = hashlib.sha256(at + key[(t - 1) * WIDTH : t * WIDTH] if t else b"").digest()[:WIDTH]
                named.append(at)
            ids.append(named)
            points.append(turns)
            tail.append(at)
        # Sums from the bottom up: nodes met first, childless ones, saved bytes.
        tops, leaves, saved, inner = [0] * many, [0] * many, [0] * many, [None] * many
        for i in range(many - 1, -1, -1):
            node, above, _, _ = order[i]
            told = []
            for t in reversed(points[i]):
                size = self.sizes[sample[i]][t - 1] if t else 0
                if not loose[i]:
                    leaves[i] += not tops[i]
                    saved[i] += (count[i] - 1) * size
                told.append((tops[i], leaves[i], saved[i], size))
                # A loose child is counted when the blocks are put together.
                tops[i] = 0 if loose[i] else 1
            inner[i] = told[::-1]
            if above >= 0:
                tops[above] += tops[i]
                leaves[above] += leaves[i]
                saved[above] += saved[i]
        held = {}  # per node of the tree: chain and smallest id of the last whole turn on its path
        for i, (node, above, _, end) in enumerate(order):
            up = (None, None) if above < 0 else held[above]
            parent = b"" if above < 0 else tail[above]
            for t, at, (kids, under, bytes_saved, size) in zip(points[i], ids[i], inner[i]):
                ends = self.ends[node.row] if node.row >= 0 and t * WIDTH == end else _NOBODY
                above_id = None if up[0] or t == 0 else up[1]
                yield at, parent if t else None, loose[i], t, least[i], above_id, count[i], kids, under, bytes_saved, size, ends, up[0] is not None
                parent, up = at, (loose[i], least[i])
            held[i] = up
        # What the two chains share was told on the first one; the last one names it once more.
        at, parent = b"", None
        for t in range(len(self.keys[last]) // WIDTH + 1 if last else 0):
            turn = self.keys[last][max(0, t - 1) * WIDTH : t * WIDTH]
            if not self.keys[0].startswith(turn, max(0, t - 1) * WIDTH):
                break
            at = hashlib.sha256(at + turn).digest()[:WIDTH]
            yield at, parent, f"{name}-1", t, None, None, 0, 0, 0, 0, 0, _NOBODY, False
            parent = at


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([
        ("node", pa.binary()), ("parent", pa.binary()), ("chain", pa.string()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes")),
        ("ends_sha256", pa.string()), ("loose", pa.bool_()),
    ])

    def written(block: Block) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in block.rows():
            rows.append(row)
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    block, held, ends = Block(most), None, None
    for batch in batches:
        for key, sizes, count, least, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "n", "least", "ids"))):
            if held is not None and held[0] == key:
                held[2] += count
                held[3] = min(held[3], least)
                ends.update(b"," + ids.encode())
                continue
            if held is not None:
                block.add(*held, ends.hexdigest())
                if block.full:
                    yield from written(block)
                    block = Block(most)
            held, ends = [key, sizes, count, least], hashlib.sha256(ids.encode())
    if held is not None:
        block.add(*held, ends.hexdigest())
        yield from written(block)


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): a conversation's turns (turn, id, bytes) in their order, null first."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said), 256)
    rows = df.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.substring(digest, 1, 2 * WIDTH).alias("id"), F.octet_length(said[1]).alias("bytes"),
    ).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "bytes"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Every conversation with its first ``taken`` turns replaced by those of conversation ``base``
    (all it has if fewer, none if there is no such conversation)."""
    theirs = own.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_theirs"))
    both = own.withColumns({"_at": base, "_taken": taken.cast("int")})
    both = both.join(theirs, F.col("_at") == F.col("_base"), "left")
    none = F.array().cast(own.schema["turns"].dataType)
    start = F.slice(F.coalesce("_theirs", none), F.lit(1), F.col("_taken"))
    rest = F.slice("turns", F.col("_taken") + 1, F.size("turns"))
    return both.select("conv_id", F.concat(start, rest).alias("turns"))


def trie(convs: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """One row per node, from (conv_id, turns): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A conversation without turns is a member of the root and ends there. Null roles and texts count
    as empty; turns with the same number stand by their ids. Rows without a conversation id belong to
    none and are not asked. Conversation ids are unique (``turns_of`` sees to that); repeated turns
    are turns of their own. An empty table has no nodes, not even a root. One conversation is one
    row, whatever its length; a text counts by its digest and its bytes only. Two turns are one when
    16 bytes of the SHA-256 of role and text agree."""
    keyed = convs.select(
        F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), "")).alias("key"),
        F.transform("turns", lambda x: x["bytes"]).alias("sizes"), "conv_id", F.shiftright("conv_id", ID_BITS).alias("part"),
    )
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    same = keyed.groupBy("key", "part").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    dealt = settle(same).repartitionByRange("key").sortWithinPartitions("key", "part").drop("part")
    parts = settle(dealt.mapInArrow(partial(_blocks, most=block_keys), _PARTS))
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    paths = parts.where("chain IS NOT NULL")
    spine = settle(
        paths.groupBy("node").agg(
            F.first("parent", ignorenulls=True).alias("parent"), F.min("chain").alias("owner"), F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"),
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("bytes").alias("bytes"),
            F.max(F.when(F.col("ends_sha256") != _NOBODY, F.col("ends_sha256"))).alias("ends"),
        )
    )
    more = spine.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("loose_kids"))
    counted = spine.join(more, "node", "left").withColumn("n_children", F.col("kids") + F.coalesce("loose_kids", F.lit(0))).drop("kids", "loose_kids")
    # What a node itself adds to its ancestors is added once, on the chain that owns it.
    own = counted.select("node", F.col("owner").alias("chain"), (F.col("n_children") == 0).cast("bigint").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("_saved"))
    below = Window.partitionBy("chain").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = paths.select("node", "chain", "depth").join(own, ["node", "chain"], "left")
    sums = along.select("node", F.sum("_leaf").over(below).alias("_leaf"), F.sum("_saved").over(below).alias("_saved"))
    totals = sums.groupBy("node").agg(F.coalesce(F.sum("_leaf"), F.lit(0)).alias("_leaf"), F.coalesce(F.sum("_saved"), F.lit(0)).alias("_saved"))
    heads = counted.join(totals, "node").select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("leaves") + F.col("_leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("_saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOBODY)).alias("ends_sha256"),
    )
    parents = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))

    inside = parts.where("chain IS NULL")
    under = inside.where("loose").drop("parent_conv_id").join(parents, "parent").select(*kept)
    top = heads.join(parents, "parent", "left").select(*kept)
    return inside.where("NOT loose").select(*kept).union(under).union(top)
