"""The physical plans are the ones meant: no pairs, no Python, early cuts, pruned scans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fleetvitals.operators import _rows
from fleetvitals.plans import bindings, report_bindings

LIBRARY = {**bindings.QUERIES, **report_bindings.QUERIES}
FOLDER = "/root/testdata/sf0.001"
BANNED = ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "ArrowEval")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(query(spark, FOLDER)) for name, query in LIBRARY.items()}


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_no_pairs_and_no_python(plans, name):
    assert not [word for word in BANNED if word in plans[name]]


@pytest.mark.parametrize("name, cuts", [("latest_per_group", 2), ("recent_n", 2), ("first_n_samples", 2)])
def test_ranked_rows_are_cut_before_the_shuffle(plans, name, cuts):
    assert plans[name].count("WindowGroupLimit") == cuts


@pytest.mark.parametrize("name", sorted(report_bindings.QUERIES))
def test_reports_are_not_sorted(plans, name):
    assert "rangepartitioning" not in plans[name]


@pytest.mark.parametrize("name", ["top_volatile", "payload_history"])
def test_limits_do_not_sort_everything(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


@pytest.mark.parametrize("name", ["count_by", "pages_to_mb", "global_ratio", "throughput_by_month"])
def test_aggregates_combine_before_the_shuffle(plans, name):
    assert "partial_" in plans[name]


@pytest.mark.parametrize(
    "name, column",
    [("unit_projection", "p_brand"), ("latest_per_group", "l_tax"), ("count_by", "props")],
)
def test_unused_columns_are_not_read(plans, name, column):
    assert column not in plans[name]


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("gauge", "EqualTo(p_type,ECONOMY)"),
        ("gauge", "StringContains(p_name,ring)"),
        ("rollover_events", "In(event_type, [error,purchase])"),
        ("count_per_member", "GreaterThan(o_totalprice,400000.0)"),
        ("counter_pair_ratio", "StringStartsWith(event_type,view)"),
    ],
)
def test_filters_reach_the_scan(plans, name, pushed):
    assert pushed in plans[name]


def test_large_joins_do_not_broadcast(spark):
    """Beyond the threshold every join has a shuffled form; nothing is forced to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("latest_per_group", "advantage_score", "union_hierarchy_count",
                     "detail_over_threshold", "last_update", "size_history", "counter_pair_ratio"):
            assert "BroadcastHashJoin" not in plan_of(contract.queries()[name](spark, FOLDER)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_offsets_are_all_that_is_broadcast(spark):
    """One row per slice; no input is broadcast by hint."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(contract.queries()["counter_delta"](spark, FOLDER))
        assert "BroadcastHashJoin [_slice" in plan_of(contract.queries()["running_totals"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["coverage_topk", "running_totals", "share_rank", "counter_delta"])
def test_bounds_are_bound_once_in_every_branch(spark, name):
    """The rows and the sums of their slices: each holds the array of bounds once, and no sort or
    limit of all rows finds it."""
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery#") <= 2 and "GlobalLimit" not in plan


@pytest.mark.parametrize("rows", [400, 6400])
def test_slices_and_their_tasks_grow_with_the_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(_rows, "SLICE_ROWS", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(rows).select("id", F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
        ranked = _rows.with_running_total(df, "v", ["id"]).withColumn("_task", F.spark_partition_id())
        assert "SortMergeJoin" not in plan_of(ranked)
        found = ranked.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    tasks = len({row["_task"] for row in found})
    assert rows / 64 / 3 < tasks <= rows / 64 * 2  # about one task a slice, at either size
    running = 0
    for rank, row in enumerate(sorted(found, key=lambda r: (-r.v, r.id)), 1):
        running += row.v
        assert (row.row_rank, row.running) == (rank, running)


def test_slices_beyond_their_number_grow(spark, monkeypatch):
    monkeypatch.setattr(_rows, "SLICE_ROWS", 8)
    monkeypatch.setattr(_rows, "DIGITS", 2)
    df = spark.range(3000).select("id", (F.col("id") % 5).alias("v"))
    placed = _rows.with_slice(df, F.struct("v", "id"), [F.col("id")])
    sizes = [r["count"] for r in placed.groupBy("_slice").count().collect()]
    assert 12 <= len(sizes) <= 16 and sum(sizes) == 3000


def test_counter_delta_reads_its_input_twice_when_it_runs(spark):
    """Once for the bounds and once for the rows; the exchange is used again for the last rows."""
    df = contract.queries()["counter_delta"](spark, FOLDER)
    df.collect()
    plan = plan_of(df)
    final = plan[: plan.index("+- == Initial Plan ==")] if "+- == Initial Plan ==" in plan else plan
    assert "ReusedExchange" in final or final.count("FileScan") <= 2


@pytest.mark.parametrize("name", ["lateral_top", "lateral_rows", "lateral_summary"])
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_lateral_subqueries_become_equi_joins(spark, name, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = plan_of(contract.queries()[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "outer(" not in plan.lower().replace("leftouter", "") and "Lateral" not in plan
    assert ("SortMergeJoin" if broadcast == "-1" else "BroadcastHashJoin") in plan
    if name == "lateral_top":
        assert "WindowGroupLimit" in plan and "Partial" in plan
    if name == "lateral_summary":
        assert "partial_count" in plan


def test_the_store_opens_only_folders_that_a_filtered_table_names(spark):
    df = contract.queries()["snapshot_store"](spark, FOLDER)
    plan = plan_of(df)
    assert "dynamicpruning" in plan and "(type#" in plan[plan.index("PartitionFilters") :]
