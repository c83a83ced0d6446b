"""Checks printed after a load, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import looks_broken
from vitrina.operators.ranking import top


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows in the table and NULLs in the column, from a single scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("filas"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return counts.unpivot("filas", df.columns, "columna", "nulos")


def table_profile(df: DataFrame, day: str) -> DataFrame:
    """One row: rows, columns, first and last day."""
    return df.agg(
        F.count(F.lit(1)).alias("filas"),
        F.min(F.to_date(day)).alias("dia_min"),
        F.max(F.to_date(day)).alias("dia_max"),
    ).withColumn("columnas", F.lit(len(df.columns)).cast("bigint"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Visits per non-null value, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("visitas"))
    if n is not None:
        return top(counts, "visitas", [column], n)
    return counts.orderBy(F.desc("visitas"), column)


def broken_values(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values that still hold broken text."""
    return df.select(column).distinct().where(looks_broken(column)).agg(F.count(F.lit(1)).alias("rotos"))
