"""Time helpers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .numeric import as_col


# Zones whose clock never changes, in which the fast conversion is the wall clock's.
STEADY_ZONES = ("UTC", "Etc/UTC", "GMT", "Z")


def _wall_seconds(moment: Column) -> Column:
    """Whole seconds on the wall clock, whatever the session's time zone."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in STEADY_ZONES:
        return F.unix_timestamp(moment)
    days = F.datediff(moment, F.lit(date(1970, 1, 1))).cast("bigint")
    return (
        days * F.lit(86400)
        + F.hour(moment) * F.lit(3600)
        + F.minute(moment) * F.lit(60)
        + F.second(moment)
    )


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Second boundaries crossed from ``start`` to ``end`` (0.9 s to 2.1 s is 2, not 1).

    The times have no zone, so an hour skipped in the session's zone does not count.
    """
    return _wall_seconds(as_col(end)) - _wall_seconds(as_col(start))


def shift_millis(moment: Column | str, millis: Column) -> Column:
    """``moment`` moved by a number of milliseconds."""
    return F.timestamp_add("MILLISECOND", millis, as_col(moment))
