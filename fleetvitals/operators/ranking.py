"""Ranking operators: coverage, shares, latest and newest rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ._rows import columns_of, exact, names, top_rows, with_running_total


def running_totals(
    df: DataFrame,
    key: str | Sequence[str],
    value: str | Column,
    *,
    measures: Mapping[str, Column] | None = None,
    scope: Sequence[str] = (),
    few_groups: bool = False,
    one_row_per_key: bool = False,
) -> DataFrame:
    """Group, rank by value (largest first), and add the sum up to and including each row.

    The same rows as joining every ranked row to all rows of equal or smaller rank and adding
    those up, without ever pairing rows. Ties in the value are broken by the key. The value is a
    whole number or decimal, negative or not; floats are refused. ``measures`` are aggregates; with ``one_row_per_key`` the rows are taken as they are, which saves the
    shuffle of the grouping, and measures are plain columns.
    """
    scope, key = names(scope), names(key)
    value = F.col(value) if isinstance(value, str) else value
    extra = [column.alias(name) for name, column in (measures or {}).items()]
    if one_row_per_key:
        rows = df.select(*scope, *key, value.alias("value"), *extra)
    else:
        rows = df.groupBy(*scope, *key).agg(F.sum(value).alias("value"), *extra)
    return with_running_total(rows, "value", key, scope, few_groups)


def coverage_topk(
    df: DataFrame,
    key: str | Sequence[str],
    value: str | Column,
    *,
    pct: int = 99,
    exclude: Sequence[object] = (),
    exclude_on: str | None = None,
    measures: Mapping[str, Column] | None = None,
    scope: Sequence[str] = (),
    few_groups: bool = False,
    one_row_per_key: bool = False,
) -> DataFrame:
    """The largest keys that together hold ``pct`` percent of the value.

    A key stays while the keys *before* it hold less than ``pct`` percent, so the key that
    crosses the line is still in, and one key holding everything is not lost. Rows whose
    ``exclude_on`` (the key, unless given) is excluded or NULL do not count towards the total.
    The comparison is by cross multiplication of exact totals. ``value`` is a whole number or
    decimal, and its sum in a group is one too; floats are refused.

    Returns scope, key, ``value``, the measures, ``row_rank``, ``preceding`` and ``share``
    (a fraction as double). A scope whose total is zero has no shares and returns no rows.
    """
    scope, key = names(scope), names(key)
    if exclude:
        df = df.where(~F.col(exclude_on or key[0]).isin(*exclude))
    ranked = running_totals(
        df,
        key,
        value,
        measures=measures,
        scope=scope,
        few_groups=few_groups,
        one_row_per_key=one_row_per_key,
    )
    preceding = (F.col("running") - exact(ranked, "value")).cast(ranked.schema["running"].dataType)
    return (
        ranked.withColumn("preceding", preceding)
        .where(F.col("preceding") * F.lit(100) < F.col("total") * F.lit(pct))
        .select(
            *scope,
            *key,
            "value",
            *(measures or {}),
            "row_rank",
            "preceding",
            "total",
            ratio("value", "total").alias("share"),
        )
    )


def share_rank(
    df: DataFrame,
    key: str | Sequence[str],
    value: str | Column,
    *,
    exclude: Sequence[object] = (),
    measures: Mapping[str, Column] | None = None,
    scope: Sequence[str] = (),
    few_groups: bool = False,
    one_row_per_key: bool = False,
) -> DataFrame:
    """Every key with its rank by value and its share of the total.

    Excluded keys and NULL keys (when something is excluded) leave before rank and share. The
    rank is a number and sorts as one. Ties are broken by the key.
    """
    scope, key = names(scope), names(key)
    if exclude:
        df = df.where(~F.col(key[0]).isin(*exclude))
    ranked = running_totals(
        df,
        key,
        value,
        measures=measures,
        scope=scope,
        few_groups=few_groups,
        one_row_per_key=one_row_per_key,
    )
    return ranked.select(
        *scope,
        *key,
        "value",
        *(measures or {}),
        "row_rank",
        "total",
        ratio("value", "total").alias("share"),
    )


def latest_per_group(
    df: DataFrame,
    group: str | Sequence[str],
    order: str | Column | Sequence[str | Column],
    *,
    where: Column | None = None,
    facts: Sequence[tuple[DataFrame, Sequence[str]]] = (),
    scope: Sequence[str] = (),
) -> DataFrame:
    """The first row of every group by ``order``, then joined to its details.

    Give ``order`` newest first and complete it to a total order. ``where`` is applied before the
    ranking; a filter on the group itself belongs there, since it cannot move below the ranking
    from the other side of the join. Details with several rows per group stay several rows.
    """
    scope, group = names(scope), names(group)
    if where is not None:
        df = df.where(where)
    # One row per group, whatever is asked: Spark cuts this rank before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*scope, *group).orderBy(*columns_of(order)))
    newest = df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    for detail, on in facts:
        newest = newest.join(detail, [*scope, *names(on)])
    return newest


def recent_n(
    df: DataFrame,
    order: str | Column | Sequence[str | Column],
    n: int = 5,
    *,
    where: Column | None = None,
    facts: Sequence[tuple[DataFrame, Sequence[str]]] = (),
    scope: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` newest *joined* rows: a row with two details counts twice towards ``n``."""
    scope = names(scope)
    if where is not None:
        df = df.where(where)
    for detail, on in facts:
        df = df.join(detail, [*[s for s in scope if s in detail.columns], *names(on)])
    return top_rows(df, columns_of(order), n, scope)


def first_n_samples(
    df: DataFrame,
    group: str | Sequence[str],
    order: str | Column | Sequence[str | Column],
    n: int = 16,
) -> DataFrame:
    """The first ``n`` distinct samples of every group, numbered from 1 as ``sample``.

    A poll that fetches the same reading again and again becomes the readings it meant to see.
    """
    return top_rows(df, columns_of(order), n, names(group), rank_as="sample")


def top_volatile(
    df: DataFrame,
    counter: str,
    order: Sequence[str],
    n: int = 50,
    *,
    facts: Sequence[tuple[DataFrame, Sequence[str]]] = (),
    scope: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` rows with the largest positive counter; ``order`` breaks ties, ascending.

    Rows with a zero or NULL counter leave before the joins.
    """
    scope = names(scope)
    moving = df.where(F.col(counter) > 0)
    for detail, on in facts:
        moving = moving.join(detail, [*scope, *names(on)])
    return top_rows(
        moving, [F.col(counter).desc(), *[F.col(c).asc() for c in order]], n, scope
    )
