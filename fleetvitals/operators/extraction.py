"""Extraction from files, payloads and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import whole_div
from ..functions.time import shift_millis
from ._rows import columns_of, names, top_rows


def rollover_events(
    rows: DataFrame,
    classes: Sequence[object],
    dim: DataFrame,
    *,
    class_column: str = "EventClass",
    dim_column: str = "trace_event_id",
    pages: str = "IntegerData",
    duration: str = "duration",
    where: Column | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Events of some classes from a set of rolled-over files, with the name of their class.

    Adds ``growth_mb`` (8 KB pages, exact as double) and ``dur_ms`` (from microseconds, fraction
    dropped). The class filter reaches the scan.
    """
    chosen = rows.where(F.col(class_column).isin(*classes))
    if where is not None:
        chosen = chosen.where(where)
    named = dim.withColumnRenamed(dim_column, class_column)
    keys = [*[s for s in names(scope) if s in dim.columns], class_column]
    return (
        chosen.join(named, keys)
        .withColumn("growth_mb", F.col(pages) * F.lit(8) / F.lit(1024.0))
        .withColumn("dur_ms", whole_div(duration, 1000))
    )


def payload_history(
    df: DataFrame,
    payload: str,
    parsed: Column,
    fields: dict[str, Column],
    order: str | Column | Sequence[str | Column],
    *,
    must_contain: str,
    n: int = 256,
    event_time: Column | None = None,
    keep: Sequence[str] = (),
    scope: Sequence[str] = (),
) -> DataFrame:
    """The newest ``n`` payloads of every scope, taken apart.

    Payloads lacking ``must_contain`` are dropped before the costly parse. ``parsed`` is the
    parse expression over ``payload`` and becomes column ``parsed``; ``fields`` are read from it
    (NULL where a part is missing). ``order`` may use the fields and must be total.
    """
    scope = names(scope)
    relevant = df.where(F.col(payload).contains(must_contain)).withColumn("parsed", parsed)
    shaped = relevant.select(
        *scope,
        *keep,
        *[column.alias(name) for name, column in fields.items()],
        *([] if event_time is None else [event_time.alias("event_time")]),
    )
    return top_rows(shaped, columns_of(order), n, scope)


def event_time_from_ticks(now: str | Column, now_ticks: str | Column, ticks: str) -> Column:
    """When an event happened, from a millisecond clock that only counts since the start."""
    now_ticks = F.col(now_ticks) if isinstance(now_ticks, str) else now_ticks
    return shift_millis(now, -(now_ticks - F.col(ticks)))


def log_lines(
    df: DataFrame, text: str, term: str, *, keep: Sequence[str] = (), ignore_case: bool = False
) -> DataFrame:
    """Log lines that contain a term, with their position.

    Whole texts are searched first and only those with a hit are split into lines.
    """

    def holds(column: str) -> Column:
        if ignore_case:
            return F.lower(F.col(column)).contains(term.lower())
        return F.col(column).contains(term)

    hits = df.where(holds(text))
    lines = hits.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(holds("line"))
