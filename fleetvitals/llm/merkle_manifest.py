"""Merkle manifest of a table: a nested-struct rollup over the digits of a row's rank.

Every row is a leaf with a rank in its group. The rank's octal digits become columns; the last digit
is grouped away first, its nodes nest as child structs under their parent, then the next digit goes,
until four levels (a block of at most 4096 leaves) stand in one row. The tops of the blocks are the
leaves of the next pass, so no row ever holds more than a block, whatever the group's size. Proofs
come from the nested rows alone: one transform writes the siblings of every level into every leaf,
one explode gives a row to each. A block meets the path above it in a grouping. Only identifiers and
digests travel; texts are hashed where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm._scratch import settle

FAN = 8
#: Digits that are grouped away in one pass; a block holds FAN ** DEPTH leaves at most.
DEPTH = 4
_STEP = "struct<left:array<string>,right:array<string>>"


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's values in their order: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A string that sorts as the group does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``_rank`` (from 0) in the group and ``_n``, the group's size.

    Rows are dealt by ranges of (group, order) and the range is written down with them, so a group of
    any size is many tasks; numbers of a range start at the sum of the ranges before it."""
    placed = settle(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    everyone = Window.partitionBy(group)
    sizes = placed.groupBy(group, "_range").agg(F.count("*").alias("_size"))
    starts = sizes.select(
        group, "_range", F.sum("_size").over(everyone).alias("_n"),
        F.coalesce(F.sum("_size").over(everyone.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    numbered = placed.withColumn("_inside", inside)
    return numbered.join(starts, [group, "_range"]).withColumn("_rank", F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def _many(level: int) -> Column:
    """Whether the group still has more than one node before ``level`` (from 1) of this pass."""
    return F.col("_n") > F.lit(FAN ** (level - 1))


def roll_up(nodes: DataFrame) -> DataFrame:
    """(group, block, _n, digest, kids): one nested row per block of nodes (group, rank, _n, digest, item)."""
    digits = [F.expr(f"CAST(_rank DIV {FAN**k} % {FAN} AS INT)").alias(f"_d{k}") for k in range(DEPTH)]
    rows = nodes.select("_group", F.expr(f"_rank DIV {FAN**DEPTH}").alias("_block"), "_n", *digits, F.struct("_rank", "digest", "item").alias("_node"))
    for level in range(1, DEPTH + 1):
        digit, left = f"_d{level - 1}", [f"_d{k}" for k in range(level, DEPTH)]
        run = F.sort_array(F.collect_list(F.struct(digit, "_node")))
        rows = rows.groupBy("_group", "_block", "_n", *left).agg(run.alias("_run"))
        rows = rows.withColumn("_kids", F.transform("_run", lambda x: x["_node"]))
        digests = F.transform("_kids", lambda x: x["digest"])
        digest = F.when(_many(level), F.sha2(F.array_join(digests, ""), 256)).otherwise(F.get(digests, F.lit(0)))
        rows = rows.select("_group", "_block", "_n", *left, F.struct(digest.alias("digest"), F.col("_kids").alias("kids")).alias("_node"))
    return rows.select("_group", "_block", "_n", F.col("_node.digest").alias("digest"), F.col("_node.kids").alias("kids"))


def passes(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every pass, written down, until each group is one block."""
    done = []
    while True:
        blocks = settle(roll_up(nodes))
        done.append(blocks)
        if (blocks.agg(F.max("_n")).first()[0] or 0) <= FAN**DEPTH:
            return done
        fewer = F.expr(f"(_n + {FAN**DEPTH - 1}) DIV {FAN**DEPTH}")
        nothing = F.lit(None).cast(nodes.schema["item"].dataType)
        nodes = blocks.select("_group", F.col("_block").alias("_rank"), fewer.alias("_n"), "digest", nothing.alias("item"))


def _leaves(kids: Column, level: int, path: Column) -> Column:
    """Nodes below ``kids`` as one flat array, each with the steps from itself up."""

    def step(i: Column) -> Column:
        digests = F.transform(kids, lambda x: x["digest"])
        beside = F.struct(F.slice(digests, 1, i).alias("left"), F.slice(digests, i + 2, F.lit(FAN)).alias("right"))
        return F.concat(F.when(_many(level), F.array(beside)).otherwise(F.array().cast(f"array<{_STEP}>")), path)

    if level == 1:
        return F.transform(kids, lambda x, i: F.struct(x["_rank"].alias("rank"), x["digest"].alias("digest"), x["item"].alias("item"), step(i).alias("path")))
    return F.flatten(F.transform(kids, lambda x, i: _leaves(x["kids"], level - 1, step(i))))


def unfold(done: list[DataFrame], above: DataFrame) -> DataFrame:
    """(group, digest, item, path, facts) of every lowest node, from (group, block 0, path, facts) of
    the groups' tops. ``facts`` are handed down as they are."""
    for blocks in reversed(done):
        kids = blocks.schema["kids"].dataType
        both = blocks.select("_group", "_block", "_n", "kids", F.lit(None).cast(f"array<{_STEP}>").alias("path"), F.lit(None).cast(above.schema["facts"].dataType).alias("facts")).unionByName(
            above.select("_group", "_block", F.lit(None).cast("bigint").alias("_n"), F.lit(None).cast(kids).alias("kids"), "path", "facts")
        )
        met = both.groupBy("_group", "_block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_n", "kids", "path", "facts")])
        below = met.select("_group", "facts", F.explode(_leaves(F.col("kids"), DEPTH, F.col("path"))).alias("_leaf"))
        above = below.select("_group", F.col("_leaf.rank").alias("_block"), "_leaf.digest", "_leaf.item", "_leaf.path", "facts")
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(F.array_join(step["left"], ""), node, F.array_join(step["right"], "")), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level from the leaf up, left to right."""
    beside = F.flatten(F.transform(path, lambda step: F.concat(step["left"], step["right"])))
    return F.sha2(F.array_join(beside, ""), 256)


def manifest(df: DataFrame, order: str, group: str, fields: Sequence[str], claim: Column | None = None) -> DataFrame:
    """One row per row of ``df``: ``order`` and ``group``, ``leaf``, ``subroot``, ``root``, ``path``
    (the siblings left and right of each level, from the leaf up), ``folded_root`` and ``verified``.

    Leaves ascend by ``order`` in their group; eight in a row become a node until one is left, and the
    groups' tops, ascending by group, do the same. ``claim`` is the leaf somebody presents for a row
    (null: the original one); ``folded_root`` is what it gives with the original siblings.

    A null ``order`` or group comes first; a null field counts as ``-``, unlike an empty one. Ties in
    ``order`` stand by their leaf; repeated rows are leaves of their own beside each other. A group of
    one row has its leaf as top. An empty table gives no rows. Other columns of ``df``, whatever their
    names, take no part. Texts of any length are hashed whole."""
    digest = leaf([F.col(f"`{c}`") for c in fields])
    claimed = F.lit(None).cast("string") if claim is None else F.when(claim != digest, claim)
    rows = settle(
        df.select(
            group_key(F.col(f"`{group}`")).alias("_group"), F.col(f"`{order}`").alias("_order"), digest.alias("digest"),
            claimed.alias("_claim"), F.col(f"`{group}`").alias("_of"), F.monotonically_increasing_id().alias("_row"),
        )
    )
    leaves = ranked(rows, "_group", ["_order", "digest", "_row"])
    nodes = leaves.select("_group", "_rank", "_n", "digest", F.struct("_order", "_of", "_claim").alias("item"))
    lower = passes(nodes)
    tops = lower[-1].select(F.lit("").alias("_all"), F.col("_group").alias("_of"), "digest")
    heads = ranked(tops, "_all", ["_of"]).select(F.col("_all").alias("_group"), "_rank", "_n", "digest", F.struct("_of").alias("item"))
    upper = passes(heads)
    empty = F.array().cast(f"array<{_STEP}>")
    root = upper[-1].select("_group", "_block", empty.alias("path"), F.struct(F.col("digest").alias("root")).alias("facts"))
    subroots = unfold(upper, root).select(
        F.col("item._of").alias("_group"), F.lit(0).cast("bigint").alias("_block"), "path",
        F.struct(F.col("digest").alias("subroot"), F.col("facts.root").alias("root")).alias("facts"),
    )
    found = unfold(lower, subroots)
    folded = found.select(
        F.col("item._order").alias(order), F.col("item._of").alias(group), F.col("digest").alias("leaf"),
        "facts.subroot", "facts.root", "path", fold(F.coalesce("item._claim", "digest"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
