"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def cut(value: Column | str, width: int = 30) -> Column:
    """First ``width`` characters without trailing blanks. For display only."""
    return F.rtrim(F.substring(as_col(value).cast("string"), 1, width))


def style_100(value: Column | str) -> Column:
    """A timestamp as ``Nov  8 2014  1:05PM``: day and hour padded with blanks to two places."""
    value = as_col(value)
    return F.concat(
        F.date_format(value, "MMM"),
        F.lit(" "),
        F.lpad(F.date_format(value, "d"), 2, " "),
        F.date_format(value, " yyyy "),
        F.lpad(F.date_format(value, "h"), 2, " "),
        F.date_format(value, ":mma"),
    )
