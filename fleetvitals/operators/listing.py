"""Listings: projection with unit conversion, filters, duplicates and key-value picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import whole_div
from ._rows import columns_of, names


def unit_projection(
    df: DataFrame,
    out: Mapping[str, str | Column],
    *,
    where: Column | None = None,
    order: str | Column | Sequence[str | Column] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Select named expressions, usually unit conversions, from the rows that pass ``where``.

    ``order`` is for presentation and may name columns that are not selected.
    """
    if where is not None:
        df = df.where(where)
    if order is not None:
        df = df.orderBy(*names(scope), *columns_of(order))
    return df.select(
        *names(scope),
        *[(F.col(e) if isinstance(e, str) else e).alias(name) for name, e in out.items()],
    )


def scoped_listing(
    df: DataFrame,
    id_column: str,
    out: Mapping[str, str | Column],
    *,
    min_id: int = 4,
    excluded_id: int = 32767,
    always_id: int = 2,
    order: str | Column | Sequence[str | Column] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """User objects (ids above ``min_id``, not the excluded one) plus one that is always shown."""
    ident = F.col(id_column)
    chosen = ((ident > min_id) & (ident != excluded_id)) | (ident == always_id)
    return unit_projection(df, out, where=chosen, order=order, scope=scope)


def drop_exact_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct combination of ``cols`` (all columns unless given), only those columns.

    Copies are combined on the map side, so a group of copies reaches the shuffle once per task.
    """
    return (df if cols is None else df.select(*cols)).distinct()


def key_value_pick(
    df: DataFrame,
    field: str | None,
    value: str | Column,
    sentinel: object,
    label: str,
    *,
    field_column: str = "Field",
    keep: Sequence[str] = (),
    shown: Column | None = None,
    alias: str = "value",
) -> DataFrame:
    """The value of one field of a key-value table, with a label in place of a sentinel.

    ``field`` None means the value is already picked. ``shown`` is the text of an ordinary value
    (the value cast to string unless given).
    """
    value = F.col(value) if isinstance(value, str) else value
    if field is not None:
        df = df.where(F.col(field_column) == field)
    text = value.cast("string") if shown is None else shown
    return df.select(
        *keep, F.when(value == F.lit(sentinel), F.lit(label)).otherwise(text).alias(alias)
    )


def size_history(
    df: DataFrame,
    details: DataFrame,
    on: str | Sequence[str],
    sizes: Mapping[str, tuple[str | Column, int]],
    keep: Sequence[str],
    *,
    where: Column | None = None,
    order: str | Column | Sequence[str | Column] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Sizes of every recorded detail over time, each divided by its unit, fraction dropped."""
    if where is not None:
        df = df.where(where)
    joined = df.join(details, [*names(scope), *names(on)])
    converted = {
        name: whole_div(column, unit).cast("bigint") for name, (column, unit) in sizes.items()
    }
    return unit_projection(
        joined, {**{k: k for k in keep}, **converted}, order=order, scope=scope
    )


def gauge(
    df: DataFrame,
    object_like: str,
    counter: str,
    *,
    object_column: str = "object_name",
    counter_column: str = "counter_name",
) -> DataFrame:
    """Readings of one counter of every object whose name contains a text.

    The object name carries the instance in front, hence "contains".
    """
    return df.where(
        F.col(object_column).contains(object_like) & (F.col(counter_column) == counter)
    )


def flagged_members(
    df: DataFrame,
    flag: Column,
    name: str,
    label: str,
    *,
    exclude: str | None = None,
    pattern: tuple[str, str] = ("Login: [", "]"),
    scope: Sequence[str] = (),
) -> DataFrame:
    """Members for which ``flag`` holds, under a label, their name in a pattern.

    ``exclude`` is one name that is left out. A NULL flag does not hold.
    """
    chosen = df.where(flag)
    if exclude is not None:
        chosen = chosen.where(F.col(name) != exclude)
    before, after = pattern
    return chosen.select(
        *names(scope),
        F.lit(label).alias("label"),
        F.concat(F.lit(before), F.rtrim(name), F.lit(after)).alias("details"),
    )
