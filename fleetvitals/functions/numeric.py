"""Exact arithmetic: totals are whole numbers, so results do not depend on row order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def whole(value: Column | str) -> Column:
    """A whole number wide enough for totals of a whole fleet."""
    return as_col(value).cast(WIDE)


def scaled(value: Column | str, places: int = 2) -> Column:
    """A float with ``places`` meaningful decimals as a whole number of that unit.

    ``rint`` and a cast to bigint stay primitive in generated code, unlike a decimal cast.
    """
    return F.rint(as_col(value) * F.lit(float(10**places))).cast("bigint")


def whole_div(a: Column | str, b: Column | str | int) -> Column:
    """Whole-number division that drops the fraction; NULL where ``b`` is zero."""
    a = as_col(a)
    if isinstance(b, int):
        return F.call_function("div", a, F.lit(b))
    b = as_col(b)
    return F.when(b != 0, F.call_function("div", a, b))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` of two exact numbers as double; NULL where ``b`` is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def _wide_div(a: Column, b: Column) -> Column:
    """Quotient of wide numbers without fraction; unlike ``div`` it may exceed 64 bits."""
    return ((a - a % b) / b).cast(WIDE)


def round_ratio(
    a: Column | str,
    b: Column | str | int,
    places: int,
    precision: int = 18,
    times: int = 1,
) -> Column:
    """``a * times / b`` rounded half up (away from zero) to ``places``, from whole numbers only.

    Everything up to the last step is whole-number arithmetic, so no binary fraction can tip
    a tie. Numbers that stay within 64 bits are divided in 64 bits, the others in wide decimals.
    NULL where ``b`` is not positive.

    Sign and unit are put on once, after either division: several ratios of a report share one
    generated method, which the JVM leaves uncompiled if it grows beyond 8000 bytes.
    """
    a = as_col(a)
    b = F.lit(b).cast("bigint") if isinstance(b, int) else as_col(b)
    factor = 2 * times * 10**places
    unit = F.lit(Decimal(1).scaleb(-places))
    short_a, short_b = F.abs(a).cast("bigint"), b.cast("bigint")
    short = F.call_function("div", short_a * F.lit(factor) + short_b, short_b * F.lit(2))
    wide_a, wide_b = F.abs(a.cast(WIDE)), b.cast(WIDE)
    wide = _wide_div(wide_a * F.lit(factor) + wide_b, wide_b * F.lit(2))
    is_short = (F.abs(a) <= F.lit(2**62 // factor)) & (b <= F.lit(2**61))
    steps = F.when(b <= 0, F.lit(None)).when(is_short, short.cast(WIDE)).otherwise(wide)
    return (steps * F.when(a < 0, -unit).otherwise(unit)).cast(f"decimal({precision},{places})")


def times_div(a: Column | str, times: int, b: Column | str) -> Column:
    """``a * times div b`` for ``a`` not negative, in 64 bits where they do and wide elsewhere.

    NULL where ``b`` is zero. The result must fit in 64 bits.
    """
    a, b = as_col(a), as_col(b)
    short = F.call_function("div", a.cast("bigint") * F.lit(times), b.cast("bigint"))
    wide = F.call_function("div", a.cast(WIDE) * F.lit(times), b.cast(WIDE))
    return F.when(b != 0, F.when(a <= F.lit(2**62 // times), short).otherwise(wide))


def early_percent(part: Column | str, total: Column | str) -> Column:
    """A percentage rounded *before* the multiplication, so only whole percents occur."""
    return (round_ratio(part, total, 2) * F.lit(100)).cast("decimal(18,2)")


def mean_of(total: Column | str, count: Column | str) -> Column:
    """Mean of whole numbers, fraction dropped."""
    return whole_div(as_col(total).cast(WIDE), as_col(count).cast(WIDE))
