from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetvitals.functions import (
    cut,
    early_percent,
    mean_of,
    ratio,
    round_ratio,
    scaled,
    seconds_between,
    shift_millis,
    style_100,
    times_div,
    whole_div,
)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_whole_division_drops_the_fraction(spark):
    assert one(spark, whole_div("a", "b"), a=7, b=2) == 3
    assert one(spark, whole_div("a", 2), a=-7) == -3
    assert one(spark, whole_div("a", "b"), a=7, b=0) is None


@pytest.mark.parametrize(
    "a, b, places, expected",
    [
        (1, 3, 2, "0.33"),
        (1, 8, 2, "0.13"),
        (29, 200, 2, "0.15"),
        (-1, 8, 2, "-0.13"),
        (2, 3, 4, "0.6667"),
        (0, 5, 1, "0.0"),
        (5, 0, 2, None),
    ],
)
def test_round_ratio(spark, a, b, places, expected):
    got = one(spark, round_ratio("a", "b", places), a=a, b=b)
    assert got == (None if expected is None else Decimal(expected))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(1, 10**12)), min_size=50, max_size=50))
def test_round_ratio_is_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select(
        "a", "b", round_ratio("a", "b", 2, 20).alias("x")
    )
    for row in df.collect():
        exact = Fraction(row.a, row.b)
        hundredths = (exact * 100 + Fraction(1, 2)).__floor__()
        assert row.x == Decimal(hundredths).scaleb(-2)


def test_times_div_beyond_64_bits(spark):
    assert one(spark, times_div("a", 10**9, "b"), a=7, b=2) == 3500000000
    assert one(spark, times_div("a", 10**9, "b"), a=10**13, b=10**6) == 10**16
    assert one(spark, times_div("a", 10, "b"), a=7, b=0) is None
    assert one(spark, times_div("a", 10**9, "b"), a=Decimal(10) ** 19, b=10**12) == 10**16


def test_round_ratio_beyond_64_bits(spark):
    assert one(spark, round_ratio("a", "b", 2, 30), a=2**62, b=3) == Decimal("1537228672809129301.33")
    assert one(spark, round_ratio("a", "b", 2, 5, times=100), a=Decimal(10) ** 30, b=Decimal(10) ** 30) == Decimal("100.00")


def test_percent_is_rounded_before_the_multiplication(spark):
    assert one(spark, early_percent("a", "b"), a=3, b=7) == Decimal("43.00")


def test_ratio_of_zero_is_null(spark):
    assert one(spark, ratio("a", "b"), a=1, b=0) is None


def test_mean_drops_the_fraction(spark):
    assert one(spark, mean_of("a", "b"), a=11, b=4) == 2


def test_scaled(spark):
    assert one(spark, scaled("a"), a=68423.46) == 6842346
    assert one(spark, scaled("a"), a=-0.29) == -29


def test_style_100_pads_day_and_hour(spark):
    assert one(spark, style_100("t"), t=datetime(2014, 11, 8, 13, 5)) == "Nov  8 2014  1:05PM"
    assert one(spark, style_100("t"), t=datetime(2014, 11, 18, 0, 5)) == "Nov 18 2014 12:05AM"


def test_cut(spark):
    assert one(spark, cut("s", 5), s="abc  defgh") == "abc"



def test_seconds_count_boundaries(spark):
    assert (
        one(
            spark,
            seconds_between("a", "b"),
            a=datetime(2024, 1, 1, 0, 0, 0, 900000),
            b=datetime(2024, 1, 1, 0, 0, 2, 100000),
        )
        == 2
    )


def test_seconds_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # a clock change lies in between
        df = spark.sql(
            "select timestamp_ntz'1969-12-31 23:59:59.5' a, timestamp_ntz'1970-01-01 00:00:00' b,"
            "timestamp_ntz'2024-03-10 01:00:00' c, timestamp_ntz'2024-03-11 01:00:01' d"
        )
        found = df.select(seconds_between("a", "b").alias("x"), seconds_between("c", "d").alias("y")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(found) == (1, 86401)


def test_shift_millis(spark):
    moved = one(spark, shift_millis("t", F.lit(-1500)), t=datetime(2024, 1, 1, 0, 0, 2))
    assert moved == datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_three_ratios_are_compiled(spark):
    """The JVM does not compile methods beyond 8000 bytes; a report shows three ratios of sums."""
    df = spark.range(9).selectExpr("id as a", "id % 5 as b", "id * 3 as c", "id % 7 as d")
    total, count = F.col("a") + F.col("c"), F.col("b") + F.col("d")
    pairs = [("a", F.lit(1) + F.col("b")), ("c", F.lit(1) + F.col("d")), (total, F.lit(1) + count)]
    found = df.select("*", *[round_ratio(x, y, 1).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    plan = found._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
