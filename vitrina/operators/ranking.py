"""Top-N, ordering, paging and option lists."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def top(df: DataFrame, metric: str, ties: list[str], n: int) -> DataFrame:
    """``n`` rows with the largest metric; ties go by the given columns, so the cut is stable."""
    return df.orderBy(*descending(metric), *ascending(*ties)).limit(n)


def listing(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """Ordered listing cut to ``n`` rows. The remaining columns break ties."""
    ordered = df.orderBy(*order, *ascending(*df.columns))
    return ordered if n is None else ordered.limit(n)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(
    df: DataFrame, columns: list[str], last: tuple | None = None, size: int = 50, newest_first: bool = True
) -> DataFrame:
    """The page behind the row whose ``columns`` are ``last`` (the first page without it). The rows
    before it are filtered out, not sorted and skipped, so a deep page costs what the first does.
    ``columns`` must tell rows apart and hold no NULL."""
    if last is not None:
        here, there = F.struct(*columns), F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, last, strict=True)])
        df = df.where(here < there if newest_first else here > there)
    return df.orderBy(*(descending(*columns) if newest_first else ascending(*columns))).limit(size)


def page_counts(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One row: total rows, page, page size, number of pages (at least 1)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("bigint").alias("total_pages"),
    )


def options(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Distinct non-null values in order, one per row."""
    value = F.col(column).alias(name or column)
    return df.where(F.col(column).isNotNull()).select(value).distinct().orderBy(name or column)


def fixed_order(c: str, values: list[str]) -> Column:
    """Position in a fixed list; values outside the list sort after it."""
    ranks = F.create_map(*[F.lit(x) for x in chain.from_iterable((v, i) for i, v in enumerate(values))])
    return F.coalesce(F.try_element_at(ranks, F.col(c)), F.lit(len(values)))
