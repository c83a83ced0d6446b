"""Wide to long, and column names for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import looked_up


def melt(df: DataFrame, keys: list[str], labels: dict[str, str], kind: str, value: str) -> DataFrame:
    """Unpivot the columns named in ``labels``, naming each by its label."""
    long = df.unpivot(keys, list(labels), kind, value)
    return long.withColumn(kind, looked_up(F.col(kind), labels))


def for_display(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The listed columns, in that order, under their display names."""
    return df.select(*[F.col(c).alias(label) for c, label in names.items()])
