"""Reports as text: fixed-width lines, cut and trimmed as a text screen shows them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..functions.text import cut, style_100

DEFAULT_WIDTH = 30

# Column name to width; None leaves a column whole.
Widths = Mapping[str, int | None]


def render_text(
    df: DataFrame, widths: Widths | None = None, default: int = DEFAULT_WIDTH
) -> DataFrame:
    """Every column as text of at most its width, trailing blanks off, times in style 100.

    This is the only place where values are shortened. NULL stays NULL.
    """
    widths = widths or {}
    shown: list[Column] = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            value = style_100(value)
        width = widths.get(field.name, default)
        text = F.rtrim(value.cast("string")) if width is None else cut(value, width)
        shown.append(text.alias(field.name))
    return df.select(*shown)


def as_lines(
    df: DataFrame, widths: Widths | None = None, default: int = DEFAULT_WIDTH
) -> DataFrame:
    """The rendered rows as one padded line each, column ``value``; whole columns are not padded."""
    widths = widths or {}
    text = render_text(df, widths, default)
    cells = []
    for name in text.columns:
        cell = F.coalesce(F.col(f"`{name}`"), F.lit("NULL"))
        width = widths.get(name, default)
        cells.append(cell if width is None else F.rpad(cell, width, " "))
    return text.select(F.rtrim(F.concat_ws(" ", *cells)).alias("value"))


# The forms of a section's banner and of the lines a report begins with.
def banner(title: str) -> str:
    return f"##########  {title} #############"


def run_header(title: str, ran_at: datetime) -> list[str]:
    """The report's title and when it ran, as the server writes a date."""
    hour = ran_at.hour % 12 or 12
    date = f"{ran_at:%b} {ran_at.day:>2} {ran_at:%Y} {hour:>2}:{ran_at:%M}{ran_at:%p}"
    return [title, banner("Date Run"), f"Date Ran : {date}"]


def _heading(title: str, df: DataFrame, widths: Widths, default: int) -> list[str]:
    names = []
    for name in df.columns:
        width = widths.get(name, default)
        names.append(name if width is None else name[:width].ljust(width))
    return [banner(title), " ".join(names).rstrip()]


def write_sections(
    sections: Mapping[str, DataFrame],
    path: str,
    widths: Mapping[str, Widths] | None = None,
    default: int = DEFAULT_WIDTH,
    header: list[str] | None = None,
) -> None:
    """All sections as text, a folder ``section=<title>`` each, in one write by the executors.

    A section's banner and column names come first, its lines follow in the order of the report:
    parts of a folder in the order of their names, lines in the order they stand in. ``header`` are
    lines written once, to the section ``header``. ``widths`` are given per section. The write is
    one job: a report is there as a whole or not at all.
    """
    if not sections:
        return
    spark = next(iter(sections.values())).sparkSession
    shape = "section string, value string"
    parts: list[DataFrame] = []
    if header:
        parts.append(spark.createDataFrame([("header", "\n".join(header))], shape).coalesce(1))
    for title, df in sections.items():
        chosen = (widths or {}).get(title, {})
        heading = "\n".join(_heading(title, df, chosen, default))
        parts.append(spark.createDataFrame([(title, heading)], shape).coalesce(1))
        parts.append(as_lines(df, chosen, default).select(F.lit(title).alias("section"), "value"))
    # Ids ascend with the lines of a part; sorted by them, the writer has no need to sort again.
    numbered = [part.withColumn("_line", F.monotonically_increasing_id()) for part in parts]
    lines = reduce(DataFrame.union, numbered).sortWithinPartitions("section", "_line")
    lines.select("section", "value").write.mode("errorifexists").partitionBy("section").text(path)
