"""Operators on hand-made rows and against brute force."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetvitals import operators as ops
from fleetvitals.operators import _rows
from fleetvitals.operators._rows import top_rows, with_running_total, with_slice
from tests.conftest import cells


@pytest.fixture(autouse=True, scope="module")
def many_slices():
    """Slices of about 32 rows, so that small tables have many."""
    before, _rows.SLICE_ROWS = _rows.SLICE_ROWS, 32
    yield
    _rows.SLICE_ROWS = before


def brute_running(rows, scope_of, value_of, key_of):
    """Every row paired with all rows before it, as a triangular join would."""
    out = {}
    for row in rows:
        before = [
            other
            for other in rows
            if scope_of(other) == scope_of(row)
            and (-value_of(other), key_of(other)) <= (-value_of(row), key_of(row))
        ]
        out[scope_of(row), key_of(row)] = (len(before), sum(map(value_of, before)))
    return out


@pytest.mark.parametrize("scope", [[], ["s"]])
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_running_total_over_slices_equals_brute_force(spark, scope, broadcast):
    rng = random.Random(7)
    # A third of the rows in one scope, many equal values, one scope without a name.
    rows = [(None if i % 5 == 0 else "ab"[i % 3 == 0], i, rng.choice([0, 5, 5, 5, 9, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, k int, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(broadcast != "-1"))
    try:
        sliced = with_running_total(df, "v", ["k"], scope).collect()
        plain = with_running_total(df, "v", ["k"], scope, few_groups=True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    def in_scope(row):
        return row[0] if scope else None

    expected = brute_running(rows, in_scope, lambda r: r[2], lambda r: r[1])
    for found in (sliced, plain):
        assert len(found) == len(rows)
        for row in found:
            at = (row.s if scope else None, row.k)
            assert (row.row_rank, int(row.running)) == expected[at]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1000)), min_size=1, max_size=60),
    st.integers(1, 6),
    st.sampled_from([50, 99, 100]),
)
def test_coverage_keeps_the_key_that_crosses_the_line(spark, rows, partitions, pct):
    df = spark.createDataFrame(rows, "k int, v int").repartition(partitions)
    found = {r.k: r.row_rank for r in ops.coverage_topk(df, "k", "v", pct=pct).collect()}
    sums: dict[int, int] = {}
    for key, value in rows:
        sums[key] = sums.get(key, 0) + value
    total, before, expected = sum(sums.values()), 0, {}
    for rank, (key, value) in enumerate(sorted(sums.items(), key=lambda i: (-i[1], i[0])), 1):
        if before * 100 < total * pct:
            expected[key] = rank
        before += value
    assert found == expected


def test_coverage_cuts_at_exactly_the_percentage(spark):
    df = spark.createDataFrame([("a", 99), ("b", 1)], "k string, v int")
    assert cells(ops.coverage_topk(df, "k", "v"), "k") == ["a"]
    big = spark.createDataFrame([("a", 995), ("b", 5)], "k string, v int")
    assert cells(ops.coverage_topk(big, "k", "v"), "k") == ["a"]


def test_coverage_of_nothing_is_empty(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    assert ops.coverage_topk(df, "k", "v").count() == 0


def test_coverage_is_the_cut_of_running_totals(spark):
    rows = [(i % 40, i * i % 97) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    totals = ops.running_totals(df, "k", "v").where("(running - value) * 100 < total * 99")
    assert set(cells(totals, "k", "row_rank")) == set(
        cells(ops.coverage_topk(df, "k", "v"), "k", "row_rank")
    )


def test_share_rank_sums_to_one_and_leaves_excluded_and_null_keys_out(spark):
    rows = [(i, 10 * i) for i in range(1, 12)] + [(32767, 10**6), (None, 10**6)]
    df = spark.createDataFrame(rows, "k int, v int")
    for few in (True, False):
        found = ops.share_rank(df, "k", "v", exclude=[32767], few_groups=few).collect()
        assert len(found) == 11
        assert abs(sum(r.share for r in found) - 1) < 1e-12
        by_rank = sorted(found, key=lambda r: r.row_rank)
        assert [r.k for r in by_rank] == list(range(11, 0, -1))


def shape_of(df):
    """The operators of a plan, without what differs between sessions and numbers."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"[^A-Za-z].*", "", line.lstrip(" :+-")) for line in plan.splitlines()]


@pytest.mark.parametrize("n", [1, 16, 1000, 1001, 5000])
def test_top_rows_are_the_same_for_every_n(spark, n):
    rows = [(None if i % 7 == 0 else "ab"[i % 3 == 0], i * 37 % 1009, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "s string, v int, i int")
    order = [F.desc("v"), F.asc("i")]
    expected = set()
    for scope in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == scope), key=lambda r: (-r[1], r[2]))[:n]
        expected |= {(*r, rank) for rank, r in enumerate(own, 1)}
    found = top_rows(df, order, n, ["s"], rank_as="r")
    assert set(map(tuple, found.collect())) == expected
    assert {tuple(r) for r in top_rows(df, order, n, ["s"]).collect()} == {e[:3] for e in expected}
    assert found.dtypes == [("s", "string"), ("v", "int"), ("i", "int"), ("r", "int")]
    without_limit = [x for x in shape_of(found) if x != "WindowGroupLimit"]
    small = [x for x in shape_of(top_rows(df, order, 2, ["s"], rank_as="r")) if x != "WindowGroupLimit"]
    # From the planner's threshold on, tasks cut their own rows first; it does that itself below.
    assert (without_limit == small) == (n < 1000)


@pytest.mark.parametrize("few", [True, False])
def test_ranking_of_fractions(spark, few):
    values = ["0.40", "0.40", "0.20", "-0.10", "1234567.89", None]
    rows = [(i, None if v is None else Decimal(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, v decimal(18,2)")
    numbers = {i: v for i, v in rows if v is not None}
    total = sum(numbers.values())
    ranked = sorted(numbers, key=lambda k: (-numbers[k], k))
    found = {r.k: r for r in ops.running_totals(df, "k", "v", few_groups=few).collect()}
    for rank, k in enumerate(ranked, 1):
        before = sum((numbers[x] for x in ranked[:rank]), Decimal(0))
        assert (found[k].row_rank, found[k].running, found[k].total) == (rank, before, total)
    assert found[5].row_rank == 6
    shares = {r.k: r.share for r in ops.share_rank(df, "k", "v", few_groups=few).collect()}
    assert shares[1] == pytest.approx(float(Decimal("0.40") / total)) and shares[5] is None
    covered = ops.coverage_topk(spark.createDataFrame(rows[:3], "k int, v decimal(18,2)"), "k", "v", pct=50, few_groups=few)
    assert sorted((r.k, r.preceding) for r in covered.collect()) == [(0, Decimal("0.00")), (1, Decimal("0.40"))]


@pytest.mark.parametrize("few", [True, False])
def test_ranking_refuses_floats(spark, few):
    df = spark.createDataFrame([(1, 0.5)], "k int, v double")
    with pytest.raises(TypeError, match="whole numbers or decimals"):
        ops.share_rank(df, "k", "v", few_groups=few)


def test_building_a_ranking_starts_no_job(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    spark.sparkContext.setJobGroup("building", "")
    try:
        for build in (ops.running_totals, ops.coverage_topk, ops.share_rank):
            build(df, "k", "id")
        ops.counter_delta(df, "k", "id", "id")
        top_rows(df, [F.desc("id")], 5000, ["k"])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_global_ratio_beyond_64_bits(spark):
    df = spark.createDataFrame([(5 * 10**18, 5 * 10**18)] * 3, "p bigint, t bigint")
    row = ops.global_ratio(df, "p", "t").first()
    assert (int(row.part_sum), str(row.part_percent), str(row.rest_percent)) == (15 * 10**18, "100.00", "0.00")


def test_latest_per_group_gives_one_row_whatever_the_partitions(spark):
    rows = [(g, t, i) for i, (g, t) in enumerate([("a", 1), ("a", 3), ("a", 3), ("b", 2)])]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "g string, t int, i int").repartition(parts)
        found = ops.latest_per_group(df, "g", [F.desc("t"), F.desc("i")])
        assert sorted(cells(found, "g", "i")) == [("a", 2), ("b", 3)]


def test_count_per_member_adds_up(spark):
    members = spark.createDataFrame([(1,), (2,), (3,)], "m int")
    facts = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "f int, v int")
    found = ops.count_per_member(members, facts, ("m", "f"))
    assert sorted(cells(found, "m", "n")) == [(1, 2), (2, 1), (3, 0)]
    limited = ops.count_per_member(members, facts, ("m", "f"), where=F.col("v") > 6)
    assert sorted(cells(limited, "m", "n")) == [(1, 0), (2, 1), (3, 0)]


def brute_delta(rows):
    last, out = {}, {}
    for key, at, number, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = last.get(key)
        out[key, number] = None if before is None else value if value < before else value - before
        last[key] = value
    return out


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
@pytest.mark.parametrize("days", [[0, 1, 2, 5, 9, 30], [0]])
def test_counter_delta_crosses_slices_and_gaps(spark, broadcast, days):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for number in range(2400):
        # Two readings of three belong to one key; days are skipped, or all is one day.
        key = "hot" if number % 3 else f"k{number % 7}"
        at = start + timedelta(days=rng.choice(days), minutes=rng.randrange(0, 1440, 60))
        rows.append((key, at, number, rng.randrange(100)))
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, n int, v int").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = ops.counter_delta(df, "k", ["at", "n"], "v").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.k, r.n): r.v_delta for r in found} == brute_delta(rows)


def test_one_busy_day_of_one_key_is_many_slices(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id"))).otherwise("hot").alias("k"),
        "id",
    )
    placed = with_slice(df, F.struct("k", "id"), [F.col("k"), F.col("id")])
    sizes = [r["count"] for r in placed.groupBy("_slice").count().collect()]
    assert len(sizes) > 400 and max(sizes) < 20000 / 100


def test_counter_delta_with_a_missing_reading(spark):
    rows = [("a", datetime(2024, 1, d), v) for d, v in [(1, 5), (2, None), (3, 9)]]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v int")
    found = dict(cells(ops.counter_delta(df, "k", "at", "v"), "at", "v_delta"))
    assert set(found.values()) == {None}


def test_first_n_samples(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("g"), "id")
    found = ops.first_n_samples(df, "g", "id", 3)
    assert sorted(cells(found, "g", "id", "sample")) == [
        (0, 0, 1), (0, 2, 2), (0, 4, 3), (1, 1, 1), (1, 3, 2), (1, 5, 3),
    ]


def test_setting_without_a_row_breaches_nothing(spark):
    df = spark.createDataFrame([(1,), (5,)], "v int")
    settings_table = spark.createDataFrame([("x", 3)], "name string, lim int")
    found = ops.setting_breach(df, settings_table, "x", F.col("v") < F.col("lim"), keep=["lim"])
    assert cells(found, "v", "lim") == [(1, 3)]
    none = ops.setting_breach(df, settings_table, "y", F.col("v") < F.col("lim"), keep=["lim"])
    assert none.count() == 0


def test_log_lines_positions(spark):
    df = spark.createDataFrame([(1, "a x\nb\nx x\n"), (2, "none")], "d int, t string")
    found = ops.log_lines(df, "t", "x", keep=["d"])
    assert cells(found, "d", "line_no", "line") == [(1, 0, "a x"), (1, 2, "x x")]


def test_duplicates_of_chosen_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None)], "i int, s string")
    assert ops.drop_exact_duplicates(df).count() == 2
    assert ops.drop_exact_duplicates(df, ["i"]).columns == ["i"]
    assert ops.drop_exact_duplicates(df, ["i"]).count() == 1


def test_name_only_join_multiplies_rows(spark):
    details = spark.createDataFrame([(1, 1, 9), (2, 1, 9), (3, 1, 5)], "o int, i int, p int")
    names = spark.createDataFrame([(1, 1, "ix"), (2, 1, "ix"), (3, 1, None)], "o int, i int, n string")
    parents = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "o int, t string")
    counts = spark.createDataFrame([("ix", 10, 1, 1), ("ix", 20, 2, 1)], "cn string, c int, o int, i int")

    def run(strict):
        found = ops.detail_over_threshold(
            details, names, parents, counts,
            names_on=["o", "i"], parents_on=["o"], name="n", counts_name="cn",
            counts_on=["o", "i"], where=F.col("p") > 5, strict_keys=strict,
        )
        return sorted(cells(found, "t", "n", "c"))

    assert run(True) == [("t1", "ix", 10), ("t2", "ix", 20)]
    assert run(False) == [("t1", "ix", 10), ("t1", "ix", 20), ("t2", "ix", 10), ("t2", "ix", 20)]


@pytest.fixture
def rooms(spark):
    outer = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 0), (3, "c", 9), (None, "d", 1)], "k int, name string, lim int")
    inner = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 9, "z"), (2, None, "u"), (2, 4, None), (None, 1, "w"), (9, 1, "v")], "k int, v int, t string")
    return outer, inner


def test_lateral_top_gives_each_row_its_own_first_rows(rooms):
    outer, inner = rooms
    order = [F.desc_nulls_last("v"), F.asc("t")]
    found = ops.lateral_top(outer, inner, {"k": "k"}, [F.col("v").alias("w"), "t"], order, 2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "a", 5, 9, "z"), (1, "a", 5, 7, "y")] * 2 + [(2, "b", 0, 4, None), (2, "b", 0, None, "u")], key=str
    )
    kept = ops.lateral_top(outer, inner, {"k": "k"}, ["v"], order, 1, where=F.col("v") > 4, how="left")
    assert sorted(((r["name"], r.v) for r in kept.collect())) == [("a", 9), ("a", 9), ("b", None), ("c", None), ("d", None)]
    assert ops.lateral_top(outer.limit(0), inner, {"k": "k"}, ["v"], order, 1).count() == 0


def test_lateral_rows_may_compare_with_the_row_at_hand(rooms):
    outer, inner = rooms
    more = F.col("v") > F.col("lim").outer()
    found = ops.lateral_rows(outer, inner, {"k": "k"}, ["t"], where=more)
    assert sorted(((r["name"], r.t) for r in found.collect()), key=str) == [("a", "y"), ("a", "y"), ("a", "z"), ("a", "z"), ("b", None)]
    kept = ops.lateral_rows(outer, inner, {"k": "k"}, ["t"], where=more, how="left")
    assert sorted({(r["name"], r.t) for r in kept.collect()}, key=str) == [("a", "y"), ("a", "z"), ("b", None), ("c", None), ("d", None)]


def test_lateral_summary_keeps_rows_without_any(rooms):
    outer, inner = rooms
    found = ops.lateral_summary(outer, inner, {"k": "k"}, {"n": F.count("*"), "most": F.max("v")}, where=F.col("t").isNotNull())
    assert sorted((r["name"], r.n, r.most) for r in found.collect() if r["name"] != "b") == [("a", 3, 9), ("a", 3, 9), ("c", 0, None), ("d", 0, None)]
    assert [(r.n, r.most) for r in found.where("name = 'b'").collect()] == [(1, None)]
