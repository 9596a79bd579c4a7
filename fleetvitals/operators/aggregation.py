"""Counting, rates, ratios and differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import early_percent, mean_of, ratio, round_ratio, times_div, whole, whole_div
from ..functions.time import seconds_between
from ._rows import columns_of, names, with_slice


def count_by(
    df: DataFrame,
    keys: str | Sequence[str],
    counted: str,
    *,
    alias: str = "n",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Rows per key whose ``counted`` column is not NULL; a group of NULLs counts 0."""
    return df.groupBy(*names(scope), *names(keys)).agg(F.count(counted).alias(alias))


def counter_pair_ratio(
    dim: DataFrame,
    counters: DataFrame,
    key: tuple[str, str],
    num_prefix: str,
    den_prefix: str,
    *,
    counter: str = "counter_name",
    value: str = "cntr_value",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Two counters of a long table side by side, joined to their owner.

    ``key`` is the owner's column in ``dim`` and in ``counters``. The long table is read once:
    only rows of the two counters stay, and one conditional sum per counter makes them columns.
    Owners lacking a counter, or whose denominator is not positive, leave. Adds ``numerator``,
    ``denominator`` and ``percent``, rounded before the multiplication by 100.
    """
    scope = names(scope)
    own, theirs = key
    is_num = F.col(counter).startswith(num_prefix)
    is_den = F.col(counter).startswith(den_prefix)
    wide = (
        counters.where(is_num | is_den)
        .groupBy(*scope, F.col(theirs).alias(own))
        .agg(
            F.sum(F.when(is_num, F.col(value))).alias("numerator"),
            F.sum(F.when(is_den, F.col(value))).alias("denominator"),
        )
        .where(F.col("numerator").isNotNull() & (F.col("denominator") > 0))
    )
    return dim.join(wide, [*scope, own]).withColumn(
        "percent", early_percent("numerator", "denominator")
    )


def throughput_by_month(
    df: DataFrame,
    size: str | Column,
    start: str,
    end: str,
    *,
    min_size: int = 5368709120,
    min_secs: int = 1,
    unit: int = 1048576,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Average, smallest and largest rate per year and month of ``end``.

    The rate of one row is size per second in ``unit``; the average is that of the rows' rates,
    not total by total. Only rows above ``min_size`` that took more than ``min_secs`` second
    boundaries count. Rates are added as whole billionths of the unit, so the average does not
    depend on row order; the fraction is dropped at the end.
    """
    parts = 10**9
    size = F.col(size) if isinstance(size, str) else size
    rated = (
        df.select(
            *names(scope),
            size.alias("_size"),
            seconds_between(start, end).alias("_secs"),
            F.col(end).alias("_end"),
        )
        .where((F.col("_size") > min_size) & (F.col("_secs") > min_secs))
        .select(
            *names(scope),
            F.year("_end").alias("year"),
            F.month("_end").alias("month"),
            times_div("_size", parts, F.col("_secs") * F.lit(unit)).alias("_rate"),
        )
    )
    return (
        rated.groupBy(*names(scope), "year", "month")
        .agg(
            F.sum(whole("_rate")).alias("_sum"),
            F.count("_rate").alias("_n"),
            F.min("_rate").alias("_min"),
            F.max("_rate").alias("_max"),
        )
        .select(
            *names(scope),
            "year",
            "month",
            whole_div(mean_of("_sum", "_n"), parts).alias("rate_avg"),
            whole_div("_min", parts).alias("rate_min"),
            whole_div("_max", parts).alias("rate_max"),
        )
    )


def count_per_member(
    members: DataFrame,
    facts: DataFrame,
    key: tuple[str, str],
    *,
    where: Column | None = None,
    alias: str = "n",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Facts per member, 0 for a member without any.

    ``key`` is the member's column in ``members`` and in ``facts``; ``where`` limits the facts,
    never the members. Facts are counted before the join, so a member holding a third of them
    reaches the join as one row.
    """
    scope = names(scope)
    own, theirs = key
    if where is not None:
        facts = facts.where(where)
    counted = facts.groupBy(*scope, F.col(theirs).alias(own)).agg(F.count("*").alias(alias))
    return members.join(counted, [*scope, own], "left").withColumn(
        alias, F.coalesce(alias, F.lit(0).cast("bigint"))
    )


def smoothed_average(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    averages: Mapping[str, tuple[str | Column, str | Column]],
    *,
    places: int = 1,
    order: Sequence[str | Column] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """``total / (1 + count)`` for each named pair, after joining the facts to their names.

    The 1 keeps a row without any operation from dividing by zero. Rounded half up. ``order`` is
    for presentation.
    """
    joined = facts.join(dim, [*names(scope), *names(on)])
    if order is not None:
        joined = joined.orderBy(*names(scope), *columns_of(order))
    for name, (total, count) in averages.items():
        count = F.col(count) if isinstance(count, str) else count
        joined = joined.withColumn(name, round_ratio(total, F.lit(1) + count, places))
    return joined


def global_ratio(
    df: DataFrame,
    part: str | Column,
    total: str | Column,
    *,
    exclude: Sequence[object] = (),
    exclude_on: str | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """What percentage of ``total`` is ``part``, and what is the rest; one row per scope.

    Sums first, divides once. NULL where the total is zero. Unlike ``coverage_topk`` no row is
    left out for having no tasks. The sums are kept as ``part_sum`` and ``total_sum``, wider than
    64 bits, since a whole fleet meets in a few rows.
    """
    part = F.col(part) if isinstance(part, str) else part
    total = F.col(total) if isinstance(total, str) else total
    if exclude:
        df = df.where(~F.col(exclude_on).isin(*exclude))
    sums = df.groupBy(*names(scope)).agg(
        F.sum(whole(part)).alias("part_sum"), F.sum(whole(total)).alias("total_sum")
    )
    return sums.select(
        *names(scope),
        "part_sum",
        "total_sum",
        round_ratio("part_sum", "total_sum", 2, 20, times=100).alias("part_percent"),
        round_ratio(
            F.col("total_sum") - F.col("part_sum"), "total_sum", 2, 20, times=100
        ).alias("rest_percent"),
        ratio("part_sum", "total_sum").alias("part_ratio"),
    )


def pages_to_mb(
    df: DataFrame,
    group: str | Sequence[str],
    *,
    id_column: str,
    min_id: int = 4,
    excluded_id: int = 32767,
    page_kb: int = 8,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Pages held per group, in MB, above the system ids and without one reserved id.

    ``pages`` times ``page_kb`` over 1024 as double: a multiple of 1/128 for 8 KB pages, which a
    double holds exactly.
    """
    return (
        df.where((F.col(id_column) > min_id) & (F.col(id_column) != excluded_id))
        .groupBy(*names(scope), *names(group))
        .agg(F.count("*").alias("pages"))
        .withColumn("mb", F.col("pages") * F.lit(page_kb) / F.lit(1024.0))
    )


def counter_delta(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    values: str | Sequence[str],
) -> DataFrame:
    """Growth of cumulative counters since the reading before; after a reset the reading itself.

    A reading below the one before it means the counter was cleared in between. The first reading
    of a key has no growth (NULL). ``order`` is ascending and total within a key. Keys are not
    NULL. Adds ``<value>_delta`` per value.

    One key may hold a large part of all readings, even within one day: readings are cut into
    slices along (key, order) whatever their number, and the last reading of a slice is handed to
    the key's first one in the next.
    """
    key, order, values = names(key), names(order), names(values)
    columns = [F.col(c) for c in [*key, *order]]
    sliced = with_slice(df, F.struct(*columns), columns)
    inside = Window.partitionBy(*key, "_slice").orderBy(*order)
    before = sliced.select(
        *df.columns,
        "_slice",
        (F.row_number().over(inside) == 1).alias("_first"),
        F.lead(F.lit(True)).over(inside).isNull().alias("_last"),
        *[F.lag(value).over(inside).alias(f"_before_{value}") for value in values],
    )
    ends = before.where("_last").select(*key, "_slice", F.struct(*values).alias("_end"))
    per_key = Window.partitionBy(*key).orderBy("_slice")
    handed = ends.select(*key, "_slice", F.lag("_end").over(per_key).alias("_handed"))
    handed = handed.where(F.col("_handed").isNotNull())
    linked = before.join(handed, [*key, "_slice"], "left")
    deltas = []
    for value in values:
        last = F.when(F.col("_first"), F.col("_handed")[value]).otherwise(F.col(f"_before_{value}"))
        now = F.col(value)
        deltas.append(F.when(now < last, now).otherwise(now - last).alias(f"{value}_delta"))
    return linked.select(*df.columns, *deltas)
