"""Ranking and running totals over the rows of one scope, without a single hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

# A slice holds about so many rows, however many there are; a bound is every so many sampled rows.
SLICE_ROWS = 1 << 20
SAMPLED_PER_SLICE = 8
# A slice's number has so many digits of base 4; beyond 2 ** 14 slices they grow instead of their number.
DIGITS = 7
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def names(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def columns_of(order: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(order, (str, Column)):
        order = [order]
    return [F.col(c) if isinstance(c, str) else c for c in order]


def exact(df: DataFrame, value: str) -> Column:
    """``value`` as the widest decimal of its own scale, so that sums are exact and have room.

    Floats have no exact sums and are refused.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, DecimalType):
        return F.col(value).cast(DecimalType(38, kind.scale))
    if isinstance(kind, IntegralType):
        return F.col(value).cast(DecimalType(38, 0))
    raise TypeError(f"{value} is {kind.simpleString()}; totals need whole numbers or decimals")


def with_slice(df: DataFrame, place: Column, key: Sequence[Column]) -> DataFrame:
    """Add ``_place`` and ``_slice``, the number of the slice a row lies in; slices follow ``place``.

    The rows with a fixed share of the hashes of ``key`` are the sample (one in 131,072), so it grows
    with the rows and slices do not. The bounds are one array in the plan (a scalar subquery that stands there
    once), so nothing runs before the query does, and every branch of it cuts alike. A row's slice
    is found digit by digit, a column for each, all in one generated loop; a place beyond the
    array's end is no bound.
    """
    share = SLICE_ROWS // SAMPLED_PER_SLICE
    sample = df.where(F.pmod(F.xxhash64(*key), F.lit(share)) == F.lit(share - 1)) if share > 1 else df
    ordered = sample.agg(F.sort_array(F.collect_list(place)).alias("_places"))
    most = F.ceil(F.size("_places") / F.lit(4**DIGITS)).cast("int")
    apart = F.greatest(F.lit(SAMPLED_PER_SLICE), most)
    bounds = ordered.select(F.filter("_places", lambda _, i: (i + 1) % apart == 0)).scalar()
    steps = [F.lit(0).alias("_at")]
    for step in (4**k for k in reversed(range(DIGITS))):
        digit, at = F.lit(0), F.col(f"_at{step * 4}" if len(steps) > 1 else "_at")
        for d in (1, 2, 3):
            reached = F.get("_bounds", at + F.lit(d * step - 1)) <= F.col("_place")
            digit = F.when(reached, d * step).otherwise(digit)
        steps.append((at + digit).alias(f"_at{step}"))
    # One projection whose columns build on each other, analysed at once.
    placed = df.select("*", place.alias("_place"), bounds.alias("_bounds"), *steps)
    # A generated column: rules that trace a join key back to the scan would write the steps out.
    return placed.select(*df.columns, "_place", F.explode(F.array("_at1")).alias("_slice"))


def with_running_total(
    df: DataFrame,
    value: str,
    key: Sequence[str],
    scope: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Add ``row_rank``, ``running`` (own row included) and ``total`` for every scope.

    Rows are ranked by ``value``, largest first, then by ``key``, which is unique in a scope.
    ``value`` is a whole number or decimal. With ``few_groups`` the caller states that a scope
    holds few rows by nature (wait types of one server, databases of one instance); a plain
    window does then. Otherwise the rows are cut into slices along that order, each slice adds up
    its own rows, and the sums of the slices before it are added on top: no task ever holds a
    whole scope. The sums are one row per slice and scope.
    """
    scope = names(scope)
    amount = exact(df, value)
    order = [F.col(value).desc(), *[F.col(k).asc() for k in key]]
    if few_groups:
        everyone = Window.partitionBy(*scope)
        so_far = everyone.orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return df.select(
            "*",
            F.row_number().over(everyone.orderBy(*order)).cast("bigint").alias("row_rank"),
            F.sum(amount).over(so_far).alias("running"),
            F.sum(amount).over(everyone).alias("total"),
        )

    # A NULL value ranks last, a NULL key first; structs compare NULL lowest.
    place = F.struct(F.col(value).isNull(), (-amount).alias("_less"), *[F.col(k) for k in key])
    # One struct stands for the scope: a NULL inside still equals a NULL, so no row is lost in
    # the join below, and the window afterwards finds the rows where the join left them.
    placed = with_slice(df, place, [F.col(c) for c in [*scope, *key]])
    in_scope = ["_scope"] if scope else []
    if scope:
        placed = placed.withColumn("_scope", F.struct(*scope))
    slice_key = [*in_scope, "_slice"]
    kind = df.schema[value].dataType
    wide = DecimalType(38, kind.scale if isinstance(kind, DecimalType) else 0)
    slices = placed.groupBy(*slice_key).agg(
        F.sum(amount).cast(wide).alias("_sum"), F.count("*").alias("_rows")
    )
    # A scope has at most 4 ** DIGITS sums, so the numbers before a slice are one small window.
    everyone = Window.partitionBy(*in_scope)
    earlier = everyone.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *slice_key,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast(wide).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_sum").over(everyone).alias("total"),
    )
    if not scope:
        offsets = F.broadcast(offsets)  # at most one row per slice
    inside = Window.partitionBy(*slice_key).orderBy("_place")
    inside_so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(offsets, slice_key).select(
        *df.columns,
        (F.col("_rows_before") + F.row_number().over(inside)).alias("row_rank"),
        (F.col("_sum_before") + F.coalesce(F.sum(amount).over(inside_so_far), F.lit(0).cast(wide)))
        .cast(wide)
        .alias("running"),
        "total",
    )


def top_rows(
    df: DataFrame,
    order: Sequence[Column],
    n: int,
    scope: Sequence[str] = (),
    rank_as: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of every scope by a total order, their rank kept as ``rank_as``.

    Spark cuts a rank below ``windowGroupLimitThreshold`` to ``n`` rows of a scope in every task
    before the shuffle. For a larger ``n`` the tasks themselves are the buckets in which rows are
    cut first. Either way a scope with a third of all rows, be they all equal, is ranked by many
    tasks. Without a scope and a rank this is a sorted limit, of which every task first takes its
    own ``n`` rows.
    """
    scope = names(scope)
    if not scope and rank_as is None:
        return df.orderBy(*order).limit(n)
    rank_name = rank_as or "_rank"
    kept = df
    if n >= int(df.sparkSession.conf.get(_GROUP_LIMIT, "1000")):
        in_bucket = Window.partitionBy(*scope, "_bucket").orderBy(*order)
        first = df.withColumn("_bucket", F.spark_partition_id())
        first = first.withColumn("_in_bucket", F.row_number().over(in_bucket))
        kept = first.where(F.col("_in_bucket") <= n).select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    kept = kept.withColumn(rank_name, rank).where(F.col(rank_name) <= n)
    return kept if rank_as else kept.drop(rank_name)
