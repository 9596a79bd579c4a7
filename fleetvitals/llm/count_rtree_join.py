"""Exact Jaccard self-join of word n-gram sets through count vectors in R-trees.

Tokens of a set are hashed into groups; the counts of the groups are a point. The overlap of two
sets is at most the sum of the coordinate minima of their points, and of a point with any point in a
tree node at most that sum with the node's upper corner. One tree over everything would be one task,
so points are first dealt into cells between which no linked pair can be lost: the hash range is cut
into more blocks than two linked sets can differ in tokens, so some block of theirs is equal; a cell
is a block's content. Equal sets are one class before anything is compared.

Within the cells, rounds find enough links to join what is linked, and the last one tests every pair
that might still join two components:

1. every member against the cell's first member;
2. in cells that still hold several components, every member outside the one that is largest in the
   whole table asks that component. The component has one tree for all cells, and a member asks it
   once, in however many cells they meet. Told are the ``PARTNERS`` whose bound is best;
3. members outside that component search the tree of what is left of their cell without it. What is
   left is small and often the same in many cells, of which one is then searched;
4. a member that had more partners asks again, now between fewer components and for eight times as
   many, until none is left.

Every pair found is verified by intersecting the sets. Pairs inside a component are never emitted,
so a group of copies costs as much as its members, not its pairs or its members times their cells.
A group of points or of those who ask is split when it is large, and each part of the one meets each
part of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm import _text
from fleetvitals.llm._graph import components, joined
from fleetvitals.llm._scratch import settle

#: So many that tokens which differ seldom meet in a group: the bound is then close to the overlap.
GROUPS = 256
#: Points that are compared at once; a smaller leaf costs more calls than it spares comparisons.
LEAF = 128
CELL_ROWS = 4096
#: Partners that a search tells of at once; a member with more asks again, for 8 times as many.
PARTNERS = 8
#: Bits of the filter that spares documents whose sets are not asked for; its size is fixed.
FILTER_BITS = 1 << 23
LEVEL_RATIO = 1.6
_MOST = 1 << 40


class CountTree:
    """R-tree over count vectors, packed by halving, by size first and then along the widest
    coordinate."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.sizes = points, points.sum(axis=1, dtype=np.int64)
        self.order = np.arange(len(points))
        self.root = self._node(0, len(points))
        # In the order of the leaves, one row per coordinate: a leaf's share of a coordinate lies together.
        self.columns = np.ascontiguousarray(points[self.order].T.astype(np.int32))
        self.sizes = self.sizes[self.order]

    def _node(self, start: int, end: int) -> tuple:
        rows = self.order[start:end]
        own, sizes = self.points[rows], self.sizes[rows]
        upper, least, most = own.max(axis=0).astype(np.int64), int(sizes.min()), int(sizes.max())
        if end - start <= LEAF:
            return upper, least, most, (start, end), None
        by = sizes if most > 1.1 * least else own[:, int(np.argmax(upper - own.min(axis=0)))]
        self.order[start:end] = rows[np.argsort(by, kind="stable")]
        half = (start + end) // 2
        return upper, least, most, None, (self._node(start, half), self._node(half, end))

    def search(self, point: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose bound allows a Jaccard similarity of ``percent``, and the bounds."""
        point = point.astype(np.int64)
        held = np.flatnonzero(point)  # only these coordinates add to a minimum
        own = point[held]
        size, stack, rows, bounds = own.sum(), [self.root], [], []
        while stack:
            upper, least, most, leaf, below = stack.pop()
            if 100 * most < percent * size or 100 * size < percent * least:
                continue
            if (100 + percent) * np.minimum(own, upper[held]).sum() < percent * (size + least):
                continue
            if leaf is None:
                stack.extend(below)
                continue
            start, end = leaf
            bound = np.minimum(self.columns[held, start:end], own[:, None].astype(np.int32)).sum(axis=0, dtype=np.int64)
            fits = (100 + percent) * bound >= percent * (size + self.sizes[start:end])
            rows.append(self.order[start:end][fits])
            bounds.append(bound[fits])
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(bounds)


def levels(percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, size beyond the largest, blocks, spare blocks) of ranges such that any two sets
    that can link without being equal lie in one range together.

    Two linked sets differ in at most (a + b)(100 - p) / (100 + p) tokens. There are more blocks by
    one than that, plus spare ones: a set with no more empty blocks than spare ones shares a block
    that is not empty with any linked set."""
    if percent >= 100:
        return []
    least = -(-percent // (100 - percent))
    out, low = [], least

    def add(lo: int, beyond: int, pair: int) -> None:
        differ = pair * (100 - percent) // (100 + percent)
        spare = differ // 6 + 4
        out.append((lo, beyond, differ + 1 + spare, spare))

    while low < _MOST:
        high = max(int(low * LEVEL_RATIO), low + 2)
        add(low, high, 2 * (high - 1))
        over = (high - 1) * 100 // percent
        if over >= high:  # a pair across the border
            add(-(-high * percent // 100), over + 1, high - 1 + over)
        low = high
    return out


def block_keys(tokens: np.ndarray, table: list[tuple[int, int, int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """For each level that a sorted set falls in: the level, how many of its cells may be left out,
    and hashes that name the cells, one per block with tokens.

    Two linked sets share more blocks than are spare, empty ones included. If each leaves out half
    of the spare blocks that it does not need for its empty ones, they still share one."""
    n, found = len(tokens), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mixed(tokens + np.uint64(1)))]) if n else None
    for number, (low, beyond, blocks, spare) in enumerate(table):
        if low > n:
            break
        if n >= beyond:
            continue
        edges = (np.arange(1, blocks, dtype=np.uint64) * np.uint64((1 << 64) // blocks)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(tokens, edges), [n]])
        full = np.diff(at) > 0
        empty = blocks - int(full.sum())
        if empty > spare:
            full[:] = True
        where = np.flatnonzero(full).astype(np.uint64)
        content = sums[at[1:]] - sums[at[:-1]]
        names = _text.mixed(content[full] + _text.mixed(where + np.uint64(number << 40) + np.uint64(7)))
        found.append((number, max(0, (spare - empty) // 2), names))
    return found


class Sets:
    """Sorted distinct token hashes of each text of a batch."""

    def __init__(self, size: int) -> None:
        self.size, self.hasher = size, _text.Hasher(51, _text.LOWER)

    def of(self, t: _text.Texts) -> list[np.ndarray]:
        w = _text.words(t, _text.SOLID)
        return _text.shingles(self.hasher.of(t.data, w.start, w.end), w.first, self.size)


def _counts(tokens: np.ndarray) -> bytes:
    """Tokens in each group; 16 bits each where that is enough."""
    counts = np.bincount((tokens & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype("<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def _point(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "<u2" if len(counts) == 2 * GROUPS else "<u4").astype(np.int64)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return (100 + percent) * int((b[place] == a).sum()) >= percent * (len(a) + len(b))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text hash and text. Id and hash name a text; equal rows share a name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_llm_id"), F.xxhash64(text).alias("_llm_hash"), text.alias("_llm_text"))


def classes(named: DataFrame, size: int) -> DataFrame:
    """Per row: id, text hash, number of tokens and the key of its set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch, t in _text.slices(batches, "_llm_text"):
            own = sets.of(t)
            yield pa.record_batch(
                [batch.column("_llm_id"), batch.column("_llm_hash"), pa.array([len(x) for x in own], pa.int64()), pa.array([_key(x) if len(x) else None for x in own], pa.binary())],
                names=["_llm_id", "_llm_hash", "n", "key"],
            )

    ids = named.schema["_llm_id"].dataType.simpleString()
    return named.mapInArrow(run, f"_llm_id {ids}, _llm_hash bigint, n bigint, key binary")


def cells(named: DataFrame, size: int, percent: int) -> DataFrame:
    """(cell, short, first) for every cell with two different sets at least; ``short`` is the
    beginning of the set's key, ``first`` the least in the cell. A task says each set once.

    A set leaves out its most crowded cells, as many as it may: those of a passage that very many
    documents share go, and no link is lost."""
    table = levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, said = Sets(size), set()
        for _, t in _text.slices(batches, "_llm_text"):
            cell, short, level = [], [], []
            for own in sets.of(t):
                if not len(own):
                    continue
                key = int.from_bytes(_key(own)[:8], "big", signed=True)
                if key in said:
                    continue
                if len(said) < 500_000:  # only spares repeated rows
                    said.add(key)
                for number, room, names in block_keys(own, table):
                    cell.append(names)
                    short.append(np.full(len(names), key, np.int64))
                    level.append(np.full(len(names), number << 40 | room, np.int64))
            if cell:
                columns = np.concatenate(cell).view(np.int64), np.concatenate(short), np.concatenate(level)
                yield pa.record_batch([pa.array(c) for c in columns], names=["cell", "short", "level"])

    rows = named.select("_llm_text").mapInArrow(run, "cell bigint, short bigint, level bigint")
    one = Window.partitionBy("cell")

    def shared(found: DataFrame) -> DataFrame:
        return found.withColumn("first", F.min("short").over(one)).withColumn("last", F.max("short").over(one)).where("first != last")

    held = settle(shared(rows).select("cell", "short", "level").distinct().withColumn("crowd", F.count(F.lit(1)).over(one)))
    order = Window.partitionBy("short", "level").orderBy(F.desc("crowd"), "cell")
    used = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.col("level").bitwiseAND((1 << 40) - 1))
    return shared(used.select("cell", "short")).select("cell", "short", "first")


def members(named: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, short, counts, tokens) of the sets whose short key is in ``wanted``.

    A filter of fixed size tells most documents that are not wanted apart where they lie, so no text
    is shuffled; a join settles the rest."""
    bit = F.pmod("short", F.lit(FILTER_BITS))
    mask = wanted.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("map"))
    seen = np.zeros(FILTER_BITS, bool)
    for r in mask.collect():  # 4096 bytes for each 32768 bits of the filter
        part = np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little")
        seen[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part[: FILTER_BITS - (r["bucket"] - 1) * len(part)]
    packed = np.packbits(seen).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, asked, said = Sets(size), np.unpackbits(np.frombuffer(packed, np.uint8)), set()
        for _, t in _text.slices(batches, "_llm_text"):
            own, keys, shorts = [], [], []
            for x in sets.of(t):
                if not len(x):
                    continue
                key = _key(x)
                short = int.from_bytes(key[:8], "big", signed=True)
                if not asked[short % FILTER_BITS] or key in said:
                    continue
                if len(said) < 500_000:  # only spares repeated rows
                    said.add(key)
                own.append(x)
                keys.append(key)
                shorts.append(short)
            yield pa.record_batch(
                [pa.array(keys, pa.binary()), pa.array(shorts, pa.int64()), pa.array(list(map(_counts, own)), pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())],
                names=["key", "short", "counts", "tokens"],
            )

    made = named.select("_llm_text").mapInArrow(run, "key binary, short bigint, counts binary, tokens binary")
    return made.join(wanted.distinct(), "short", "left_semi").dropDuplicates(["short", "key"])  # the join has dealt them by short


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose counts' bound allows a link."""
    left = sets.select(F.col("key").alias("a"), F.col("counts").alias("ca"))
    right = sets.select(F.col("key").alias("b"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for x, y in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist()):
                x, y = _point(x), _point(y)
                fits.append((100 + percent) * int(np.minimum(x, y).sum()) >= percent * int(x.sum() + y.sum()))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets link; a pair given once is told once."""
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            fits = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(own, other)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, dict[str, np.ndarray]]]:
    """(group, part, chunk), whether they ask, and the columns of neighbouring rows that agree in
    these. Rows are sorted by them; a run may go on in the next batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([(rows[c][1:] != rows[c][:-1]).astype(bool) for c in ("group", "part", "chunk", "asks")], axis=0)
        edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            yield (rows["group"][i], int(rows["part"][i]), int(rows["chunk"][i])), bool(rows["asks"][i]), {c: v[i:j] for c, v in rows.items()}


def _partners(tree: CountTree, keys: np.ndarray, comps: np.ndarray, asking: dict[str, np.ndarray], percent: int) -> tuple[set[tuple[bytes, bytes]], list[tuple[bytes, int]]]:
    """Pairs of those who ask with points of the tree, and who had more than they may tell of, with
    the number that they may tell of next time."""
    out: set[tuple[bytes, bytes]] = set()
    more, kinds = [], set(comps)
    for key, own, counts, most in zip(asking["key"], asking["comp"], asking["counts"], asking["most"]):
        if kinds == {own}:
            continue
        hits, bounds = tree.search(_point(counts), percent)
        other = comps[hits] != own
        hits, bounds = hits[other], bounds[other]
        if len(hits) > most:
            more.append((key, int(most) * 8))
            hits = hits[np.lexsort([keys[hits], -bounds])[:most]]
        out.update((min(key, keys[i]), max(key, keys[i])) for i in hits)
    return out, more


def opened(inside: DataFrame, labels: DataFrame, size: int, *order: str) -> DataFrame:
    """(cell, key, comp, main, total, comps) of the cells with several components and ``size``
    members at least; ``main`` is the component that comes last by ``order``, of its members in the
    cell (``n``) and anywhere (``all``), and ``total`` the latter. Of cells with the same members one is taken."""
    totals = labels.groupBy("label").agg(F.count(F.lit(1)).alias("all"))
    known = labels.join(totals, "label").select("node", "label", "all")
    placed = settle(inside.join(known, inside["key"] == known["node"], "left").select("cell", "key", F.coalesce("label", "key").alias("comp"), F.coalesce("all", F.lit(1)).alias("all")))
    sizes = placed.groupBy("cell", "comp", "all").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark"))
    several = (
        sizes.groupBy("cell").agg(F.max(F.struct(*order, "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), F.sum("mark").alias("mark"))
        .where((F.col("comps") > 1) & (F.col("size") >= size))
    )
    once = several.groupBy("mark", "size").agg(F.min(F.struct("cell", F.col("top.comp").alias("main"), F.col("top.all").alias("total"), "comps")).alias("one")).select("one.*")
    return placed.select("cell", "key", "comp").join(once, "cell")


def searched(index: DataFrame, asks: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of keys of different components whose bound allows a link: for each row of
    ``asks`` (group, key, most) the ``most`` best of the rows of ``index`` (group, key) in its group.
    Who had more is told as well, as a row with its key as ``a``, its ``group`` and the next ``most``.

    A group of more than ``CELL_ROWS`` points or asking rows is a grid of parts, so a task holds one
    tree of about that size, whatever the group's size."""
    rows = index.select("group", "key", F.lit(False).alias("asks"), F.lit(0).cast("bigint").alias("most")).unionByName(asks.select("group", "key", F.lit(True).alias("asks"), "most"))
    parts, chunks = (F.ceil(F.count_if(c) / CELL_ROWS).cast("int") for c in (~F.col("asks"), F.col("asks")))
    large = rows.groupBy("group").agg(parts.alias("parts"), chunks.alias("chunks")).where("parts > 1 or chunks > 1")
    rows = rows.join(F.broadcast(large), "group", "left").fillna(1, ["parts", "chunks"])  # few: one for CELL_ROWS rows at most
    rows = rows.join(labels, rows["key"] == labels["node"], "left").select(*rows.columns, F.coalesce("label", "key").alias("comp"))
    rows = rows.join(sets.select("key", "counts"), "key")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("asks"), F.col("chunks")).otherwise(F.col("parts"))).cast("int")
    to_parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), own.alias("chunk")))
    to_chunks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(own.alias("part"), i.alias("chunk")))
    spread = rows.where("parts > 0 and chunks > 0").withColumn("to", F.explode(F.when(F.col("asks"), to_parts).otherwise(to_chunks)))
    dealt = spread.select("group", "to.part", "to.chunk", "asks", "key", "comp", "counts", "most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[bytes, bytes]] = set()
        at, kept, tree = None, [], None
        for name, asking, one in _runs(batches):
            if name != at:
                at, kept, tree = name, [], None
            if not asking:
                kept.append(one)
                continue
            if tree is None:
                if not kept:
                    continue
                keys, comps = (np.concatenate([k[c] for k in kept]) for c in ("key", "comp"))
                tree = CountTree(np.stack([_point(c) for k in kept for c in k["counts"]]))
            found, more = _partners(tree, keys, comps, one, percent)
            fresh = sorted(found - said)
            if len(said) < 500_000:  # only spares what the task has said before
                said.update(fresh)
            if fresh or more:
                a, b = [p[0] for p in fresh] + [m[0] for m in more], [p[1] for p in fresh] + [None] * len(more)
                group, most = [None] * len(fresh) + [name[0]] * len(more), [None] * len(fresh) + [m[1] for m in more]
                yield pa.record_batch([*(pa.array(x, pa.binary()) for x in (a, b, group)), pa.array(most, pa.int64())], names=["a", "b", "group", "most"])

    sorted_rows = dealt.repartition("group", "part", "chunk").sortWithinPartitions("group", "part", "chunk", "asks")
    return sorted_rows.mapInArrow(run, "a binary, b binary, group binary, most bigint").distinct()


def ngram_join(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``_llm_hash`` of its text, ``n_shingles``, ``component_id`` (the
    smallest id that can be reached over links), and ``_llm_component``, the component's own key.

    Words are lower-case runs of what is not blank; a set has the distinct ``size``-word shingles, or
    the whole sequence of a shorter text. Two documents link when their Jaccard similarity is at
    least ``percent``. Empty and null texts link with nothing and keep their own id. Repeated rows
    give repeated rows; null ids are passed over when the smallest is taken; an empty table gives an
    empty one; other columns are not read. A tree holds about ``CELL_ROWS`` points, whatever the
    size of a group, and about as many rows ask it."""
    named = _named(docs, id_col, text_col)
    keyed = settle(classes(named, size))
    held = settle(cells(named, size, percent))
    sets = settle(members(named, held.select("short"), size))
    names = sets.select("short", "key")
    first = names.select(F.col("short").alias("first"), F.col("key").alias("first_key"))
    placed = settle(held.join(names, "short").join(first, "first").select("cell", "key", "first_key"))

    stars = placed.where("key != first_key").select(F.least("key", "first_key").alias("a"), F.greatest("key", "first_key").alias("b")).distinct()
    labels = components(settle(verified(settle(possible(stars, sets, percent)), sets, percent)))

    # The pair of a cell of two has been tested. A component of one set is no main.
    rows = settle(opened(placed.select("cell", "key"), labels, 3, "all", "n").where("total = 1 or comp != main"))
    most = F.lit(PARTNERS).cast("bigint").alias("most")
    asks = settle(rows.where("total > 1").select(F.col("main").alias("group"), "key").distinct().select("group", "key", most))
    index = settle(labels.join(asks.select("group").distinct(), F.col("label") == F.col("group"), "left_semi").select(F.col("label").alias("group"), F.col("node").alias("key")))
    rest = rows.where("comps > if(total > 1, 2, 1)").select("cell", "key")
    while True:
        found = settle(searched(index, asks, labels, sets, percent))
        more = settle(verified(found.where("b is not null").select("a", "b"), sets, percent))
        if not more.isEmpty():
            labels = joined(labels, more)
        asks = found.where("b is null").select("group", F.col("a").alias("key"), "most")
        index = index.join(asks.select("group").distinct(), "group", "left_semi")
        if rest is not None:
            within = settle(opened(rest, labels, 2, "n", "all").select(F.unhex(F.hex("cell")).alias("group"), "key", (F.col("comp") != F.col("main")).alias("asks")))
            asks = asks.unionByName(within.where("asks").select("group", "key", most))
            index, rest = index.unionByName(within.select("group", "key")), None
        if asks.isEmpty():
            break
        asks, index = settle(asks), settle(index)

    labelled = keyed.join(labels, keyed["key"] == labels["node"], "left").select(keyed["*"], F.coalesce("label", "key").alias("comp"))
    smallest = keyed.where("key is not null").groupBy("key").agg(F.min("_llm_id").alias("id")).join(labels, F.col("key") == F.col("node"), "left")
    smallest = smallest.groupBy(F.coalesce("label", "key").alias("root")).agg(F.min("id").alias("least_id"))
    out = labelled.join(smallest, F.col("comp") == F.col("root"), "left")
    return out.select(F.col("_llm_id").alias(id_col), "_llm_hash", F.col("n").alias("n_shingles"), F.coalesce("least_id", "_llm_id").alias("component_id"), F.col("comp").alias("_llm_component"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links join: the smallest id, then text hash.

    Rows equal in id and text count as one document and one of them stays. Texts without words are
    in no group and all stay."""
    found = ngram_join(docs, size, percent, id_col, text_col)
    whole = docs.withColumn("_llm_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    first = found.where("n_shingles > 0").groupBy("_llm_component").agg(F.min(F.struct(id_col, "_llm_hash")).alias("at"))
    kept = first.select(F.col(f"at.{id_col}").alias("_llm_kept_id"), F.col("at._llm_hash").alias("_llm_kept_hash"))
    own = whole.join(kept, whole[id_col].eqNullSafe(kept["_llm_kept_id"]) & (whole["_llm_hash"] == kept["_llm_kept_hash"]), "left_semi")
    one = own.withColumn("_llm_row", F.row_number().over(Window.partitionBy(id_col, "_llm_hash").orderBy(F.lit(0)))).where("_llm_row = 1")
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return one.select(docs.columns).unionByName(docs.where(blank))
