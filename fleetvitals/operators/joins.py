"""Joins of facts with their owners, names and settings.

No side is broadcast by hint: Catalyst and AQE broadcast a side whose measured size is below the
session's threshold, and sort-merge join with skew splitting otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import names


def distinct_lateral(
    df: DataFrame,
    attributes: DataFrame,
    on: str | Sequence[str],
    columns: Sequence[str | Column],
    *,
    scope: Sequence[str] = (),
) -> DataFrame:
    """The distinct attribute rows reached from ``df``; rows reaching none add none.

    ``columns`` come from the attribute side only, so the keys are made distinct before the join
    and a key with a third of all rows joins once.
    """
    keys = [*names(scope), *names(on)]
    reached = df.select(*keys).distinct().join(attributes, keys)
    return reached.select(*names(scope), *columns).distinct()


def advantage_score(
    stats: DataFrame,
    bridge: DataFrame,
    details: DataFrame,
    on_bridge: str | Sequence[str],
    on_details: str | Sequence[str],
    factors: Sequence[str | Column],
    *,
    factor: float = 0.01,
    alias: str = "advantage",
    where: Column | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Statistics joined over a bridge table to details, with the product of the factors.

    The last factor is multiplied by ``factor`` first (a percentage becomes a fraction).
    """
    scope = names(scope)
    if where is not None:
        details = details.where(where)
    joined = stats.join(bridge, [*scope, *names(on_bridge)]).join(
        details, [*scope, *names(on_details)]
    )
    cols = [F.col(f) if isinstance(f, str) else f for f in factors]
    score = cols[-1] * F.lit(factor)
    product = cols[0]
    for col in cols[1:-1]:
        product = product * col
    return joined.withColumn(alias, product * score)


def lateral_attribute_rollup(
    facts: DataFrame,
    attributes: DataFrame,
    on: str | Sequence[str],
    attribute: str,
    value: str | Column,
    *,
    name_column: str = "attribute",
    value_column: str = "value",
    cast: str = "int",
    alias: str = "owner",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Facts added up by one named attribute of a long attribute table.

    Facts without the attribute leave. Facts are added up per join key before the join and per
    attribute after it.
    """
    keys = [*names(scope), *names(on)]
    value = F.col(value) if isinstance(value, str) else value
    chosen = attributes.where(F.col(name_column) == attribute).select(
        *keys, F.col(value_column).cast(cast).alias(alias)
    )
    per_key = facts.groupBy(*keys).agg(F.sum(value).alias("_part"))
    return (
        per_key.join(chosen, keys)
        .groupBy(*names(scope), alias)
        .agg(F.sum("_part").cast("bigint").alias("value"))
    )


def union_hierarchy_count(
    branches: Sequence[DataFrame],
    dim: DataFrame,
    facts: DataFrame,
    dim_on: str | Sequence[str],
    facts_on: str | Sequence[str],
    group: Sequence[str],
    *,
    alias: str = "n",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Facts counted per member of a hierarchy that is put together from several branches.

    The branches are appended (duplicates stay), optional names come from ``dim`` by a left join,
    and facts reach the members by ``facts_on``. Facts are counted per key before the join.
    """
    scope = names(scope)
    members = branches[0]
    for branch in branches[1:]:
        members = members.unionByName(branch)
    named = members.join(dim, [*scope, *names(dim_on)], "left")
    keys = [*scope, *names(facts_on)]
    counted = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (
        counted.join(named, keys)
        .groupBy(*scope, *group)
        .agg(F.sum("_n").alias(alias))
    )


def setting_breach(
    df: DataFrame,
    settings: DataFrame,
    name: str,
    breached: Column,
    *,
    name_column: str = "name",
    keep: Sequence[str],
    scope: Sequence[str] = (),
) -> DataFrame:
    """Rows for which a named setting breaks a condition.

    ``keep`` are the setting's columns, usable in ``breached``. With a scope the setting is joined
    by it. Without one the setting is a single row by its name; it enters the plan as a scalar
    subquery, so no join is planned at all and two settings of one name raise an error.
    """
    scope = names(scope)
    chosen = settings.where(F.col(name_column) == name).select(*scope, *keep)
    if scope:
        joined = df.join(chosen, scope)
    else:
        record = chosen.select(F.struct(*keep)).scalar()
        joined = df.withColumn("_setting", record).select(
            *df.columns, *[F.col("_setting")[c].alias(c) for c in keep]
        )
    return joined.where(breached)


def dimension_listing(
    df: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    text: str,
    n: int = 87,
    *,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Rows joined to their category, with one long text shortened for the listing."""
    return df.join(dim, [*names(scope), *names(on)]).withColumn(
        text, F.substring(text, 1, n)
    )


def detail_over_threshold(
    details: DataFrame,
    names_table: DataFrame,
    parents: DataFrame,
    counts: DataFrame,
    *,
    names_on: Sequence[str],
    parents_on: Sequence[str],
    name: str,
    counts_name: str,
    counts_on: Sequence[str],
    where: Column,
    strict_keys: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Detail rows above a threshold with name, parent and count: a four-way join.

    Rows without a name leave. The count table is joined by its keys. With
    ``strict_keys=False`` it is joined by name alone, which multiplies rows whose name occurs
    more than once; that is how the report this stands for was written.
    """
    scope = names(scope)
    large = details.where(where)
    named = names_table.where(F.col(name).isNotNull())
    joined = large.join(named, [*scope, *names_on]).join(parents, [*scope, *parents_on])
    if strict_keys:
        counts = counts.drop(counts_name)
        return joined.join(counts, [*scope, *counts_on])
    counts = counts.drop(*counts_on).withColumnRenamed(counts_name, name)
    return joined.join(counts, [*scope, name])


def last_update(
    members: DataFrame,
    facts: DataFrame,
    key: Sequence[tuple[str, str]],
    time: str,
    *,
    alias: str = "last_update",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Every member with the time of its last fact; NULL if there is none.

    ``key`` pairs the member's column with the fact's. The newest time is taken per key before
    the join.
    """
    scope = names(scope)
    newest = facts.groupBy(*scope, *[F.col(theirs).alias(own) for own, theirs in key]).agg(
        F.max(time).alias(alias)
    )
    return members.join(newest, [*scope, *[own for own, _ in key]], "left")


def _lateral(
    df: DataFrame,
    inner: DataFrame,
    on: Mapping[str, str],
    found: Callable[[DataFrame], DataFrame],
    how: str,
) -> DataFrame:
    """``found`` (a function of the inner rows that belong to the row at hand) beside every row.

    The row's keys go under names of their own: a name the inner side has too would mean its own
    column there."""
    named = {f"_outer_{outer}": outer for outer in on}
    keyed = df.select("*", *[F.col(column).alias(name) for name, column in named.items()])
    pairs = [F.col(on[column]) == F.col(name).outer() for name, column in named.items()]
    return keyed.lateralJoin(found(inner.where(reduce(Column.__and__, pairs))), how=how).drop(*named)


def lateral_rows(
    df: DataFrame,
    inner: DataFrame,
    on: Mapping[str, str],
    columns: Sequence[str | Column],
    *,
    where: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Every row with the ``columns`` of the inner rows that belong to it.

    ``on`` maps columns of ``df`` to inner ones; ``where`` may compare inner columns with those of
    the row at hand, written ``F.col(name).outer()`` where the inner side has no such name. A row
    without any is left out, or kept with NULLs by ``how="left"``. The optimizer turns this into one
    equi-join.
    """
    return _lateral(
        df, inner, on, lambda own: (own if where is None else own.where(where)).select(*columns), how
    )


def lateral_top(
    df: DataFrame,
    inner: DataFrame,
    on: Mapping[str, str],
    columns: Sequence[str | Column],
    order: Sequence[Column],
    n: int,
    *,
    where: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Every row with the first ``n`` inner rows that belong to it, by a total order.

    ``where`` is about inner columns only. The subquery with its limit becomes a rank per key that
    tasks cut to ``n`` before the shuffle, and a join, so a key with very many rows is no burden.
    """
    rows = inner if where is None else inner.where(where)
    return _lateral(
        df, rows, on, lambda own: own.orderBy(*order).limit(n).select(*columns), how
    )


def lateral_summary(
    df: DataFrame,
    inner: DataFrame,
    on: Mapping[str, str],
    measures: Mapping[str, Column],
    *,
    where: Column | None = None,
) -> DataFrame:
    """Every row with aggregates over the inner rows that belong to it.

    A row without any keeps its place: counts are 0 and other measures NULL, as an aggregate over
    nothing says. ``where`` is about inner columns only; a comparison with the row at hand under an
    aggregate would pair rows. Inner rows are added up per key before they are joined.
    """
    rows = inner if where is None else inner.where(where)
    shown = [value.alias(name) for name, value in measures.items()]
    return _lateral(df, rows, on, lambda own: own.select(*shown), "left")
