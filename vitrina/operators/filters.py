"""Composable filters. Values never become SQL text."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.clock import year_month

# Choices that mean "no filter".
ALL_CHOICES = frozenset({"Todas", "Todos", "todas", "todos", ""})


def chosen(df: DataFrame, **values: object) -> DataFrame:
    """Keep rows equal to every given value; ``None`` and the "all" choices do not filter."""
    for column, value in values.items():
        if value is not None and value not in ALL_CHOICES:
            df = df.where(F.col(column) == F.lit(value))
    return df


def between_days(
    df: DataFrame, column: str, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Inclusive day range, the whole last day included. DATE and timestamp columns are compared
    uncast, so the bounds reach the parquet scan; text is read as a date first."""
    kind = df.schema[column].dataType.simpleString()
    moment = F.col(column).try_cast("date") if kind == "string" else F.col(column)
    kind = "date" if kind == "string" else kind
    if start is not None:
        df = df.where(moment >= F.lit(str(start)).cast(kind))
    if end is not None:
        df = df.where(moment < F.date_add(F.lit(str(end)).cast("date"), 1).cast(kind))
    return df


def between_months(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Inclusive range of ``YYYYMM``. The year bounds that follow from it are stated as well: they
    reach the scan of a table that is not partitioned, the month range prunes one that is."""
    if start is not None:
        df = df.where((F.col("anio") >= start // 100) & (year_month() >= start))
    if end is not None:
        df = df.where((F.col("anio") <= end // 100) & (year_month() <= end))
    return df


def plausible_years(df: DataFrame, column: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Keep days from the first of year ``first`` to the last of year ``last``, where given. The
    column is compared uncast with dates, so the bounds reach the scan."""
    start = None if first is None else date(first, 1, 1)
    end = None if last is None else date(last, 12, 31)
    return between_days(df, column, start, end)


def containing(column: str, text: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` act as wildcards."""
    return F.col(column).ilike(f"%{text}%")


def containing_any(columns: list[str], text: str) -> Column:
    return reduce(or_, [containing(c, text) for c in columns])
