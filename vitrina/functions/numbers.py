"""Totals, means, ratios and the two rounding modes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x: Column, digits: int = 0) -> Column:
    """Round to the nearest, ties to the even digit."""
    if digits == 0:
        return F.bround(x, 0)
    scale = float(10**digits)
    return F.bround(x * F.lit(scale), 0) / F.lit(scale)


def half_up(x: Column, digits: int = 0) -> Column:
    """Round to the nearest, ties away from zero."""
    if digits == 0:
        return F.round(x, 0)
    scale = float(10**digits)
    return F.round(x * F.lit(scale), 0) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(
    numerator: ColumnLike,
    denominator: ColumnLike,
    digits: int = 1,
    rounding: Callable[[Column, int], Column] = half_even,
    empty: float | None = None,
) -> Column:
    """Rounded percentage; ``empty`` replaces the NULL of a zero denominator."""
    value = rounding(ratio(as_column(numerator), as_column(denominator)) * F.lit(100.0), digits)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def total(c: ColumnLike) -> Column:
    """Sum that is 0, not NULL, over no values."""
    return F.coalesce(F.sum(as_column(c)), F.lit(0))


def amount(c: ColumnLike) -> Column:
    """Sum of a decimal quantity as double. The decimal sum is exact, so the result does
    not depend on how the rows were split over tasks."""
    return F.coalesce(F.sum(as_column(c)).cast("double"), F.lit(0.0))


def mean(c: ColumnLike) -> Column:
    """Mean as double from the exact sum; NULL over no values."""
    c = as_column(c)
    return ratio(F.sum(c), F.count(c))


def id_bits(c: str) -> Column:
    """Whole-number ids of one word (``id >> 6``) merged into 64 bits; NULL without any."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(c).bitwiseAND(63).cast("int")))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)
