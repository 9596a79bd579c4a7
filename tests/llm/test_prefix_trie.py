from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import prefix_trie as p
from fleetvitals.llm import queries
from tests.parity import connect, differences

from .conftest import SF

TABLE = "conv_id bigint, turn bigint, role string, text string"
SHOWN = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain_turns(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, turn_id(role, text)), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    """Rows of every node, each found by looking at all prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), above, len(held), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*SHOWN).collect()), key=str)


def some(n, seed, words=3, depth=6):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", None]), r.choice(["a", "é日", "", "longer text"][:words])) for c in range(n) for t in range(r.randint(0, depth))]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_of_any_size_give_the_same_nodes(spark, block):
    rows = some(150, block)
    own = plain_turns(rows)
    df = p.turns_of(spark.createDataFrame(rows, TABLE).repartition(3))
    assert found(p.trie(df, block)) == plain_trie(own)


def test_layouts_grow_and_paths_are_split():
    r = random.Random(5)
    keys = {bytes([r.randrange(256)]) + bytes(r.randrange(2) for _ in range(p.WIDTH - 1)) for _ in range(2000)}
    keys |= {k + bytes(p.WIDTH) for k in list(keys)[:50]} | {bytes(p.WIDTH * 3)}
    root = p.Node(b"")
    for i, key in enumerate(sorted(keys)):
        p.insert(root, key, i)
    assert isinstance(root.kids, p.Full)
    back, kinds, todo = {}, set(), [(root, b"")]
    while todo:
        node, at = todo.pop()
        at += node.path
        if node.row >= 0:
            back[node.row] = at
        if node.kids:
            kinds.add(type(node.kids))
            # a node has a row of its own or at least two ways on
            assert node is root or node.row >= 0 or len(node.kids.all()) > 1
            todo += [(kid, at + bytes([b])) for b in range(256) if (kid := node.kids.find(b))]
    assert [back[i] for i in range(len(back))] == sorted(keys) and p.Few in kinds


@pytest.mark.parametrize("children", [3, 16, 17, 48, 49, 256])
def test_each_layout_finds_all_its_children(children):
    node, order = p.Node(b""), list(range(children))
    random.Random(children).shuffle(order)
    for b in order:
        node.put(b, p.Node(bytes([b])))
    kind = p.Few if children <= 16 else p.Indexed if children <= 48 else p.Full
    assert type(node.kids) is kind
    assert [n.path[0] for n in node.kids.all()] == list(range(children))
    assert node.kids.find(0).path == b"\0" and (children > 255 or node.kids.find(255) is None)


def test_odd_rows_ties_gaps_and_clashing_names(spark):
    rows = [
        (1, None, "user", "first"), (1, 2, None, None), (1, 2, "user", "tie"), (1, 2, "user", "tie"), (None, 0, "user", "nobody's"),
        (2, 0, "user", "x" * 300_000), (11, 5, "user", "own"), (-4, 0, "", ""), (5, 0, "user", "é"), (6, 0, "user", "é"), (7, 9, "user", "é"),
    ]
    df = spark.createDataFrame(rows, TABLE).withColumns({c: F.lit("x") for c in ("key", "part", "n", "least", "turns", "id", "node", "depth", "_base")})
    own = plain_turns(rows)
    assert found(p.trie(p.turns_of(df), 2)) == plain_trie(own)
    assert p.trie(p.turns_of(df.limit(0))).count() == 0
    none = spark.createDataFrame([(3, [])], "conv_id bigint, turns array<struct<turn: bigint, id: string, bytes: int>>")
    assert found(p.trie(none)) == plain_trie({3: []})


def test_many_equal_conversations_and_one_first_turn(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(700) for t in range(3)] + [(c, t, "user", f"t{0 if t == 0 else c}") for c in range(700, 900) for t in range(3)]
    df = p.turns_of(spark.createDataFrame(rows, TABLE).repartition(5))
    assert found(p.trie(df, 16)) == plain_trie(plain_turns(rows))


def test_rebuilt_conversations(spark):
    rows = some(60, 9, depth=9)
    rows = [r for r in rows if r[0] not in (10, 25)]  # conversations whose base is absent
    own = p.turns_of(spark.createDataFrame(rows, TABLE))
    convs = p.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9)
    assert found(p.trie(convs, 7)) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_query_equals_its_sql(spark):
    assert differences(queries.op11_prefix_trie(spark, SF), connect(SF), queries.ORACLE["op11_prefix_trie"]) is None
