"""Attribute joins.

None of these hints a broadcast. The dimension side is broadcast by the planner or by AQE when
its size is under the configured threshold, otherwise both sides are shuffled and AQE splits hot
keys of the fact side. Jobs aggregate to the lookup key first wherever the result allows it, so
that a hot key is one row by the time it is joined.

A dimension that is known to hold one row per id says so in the metadata of its id column. Parquet keeps the
mark, so a dimension written once with ``write_dimension`` joins without another grouping and with only the
columns a job reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import blank_to_null

#: Metadata of an id column that no two rows share.
ONE_ROW = "one_row_per_id"


def marked_unique(dim: DataFrame, key: str = "id") -> DataFrame:
    """``dim``, which the caller knows to hold one row per ``key``, with the mark. Filters and projections keep
    the mark; a union or a join that repeats rows has to be marked anew or read through ``unmarked``."""
    return dim.withMetadata(key, {**dim.schema[key].metadata, ONE_ROW: True})


def unmarked(dim: DataFrame, key: str = "id") -> DataFrame:
    kept = {k: v for k, v in dim.schema[key].metadata.items() if k != ONE_ROW}
    return dim.withMetadata(key, kept)


def is_unique(dim: DataFrame, key: str = "id") -> bool:
    return bool(dim.schema[key].metadata.get(ONE_ROW))


def one_row_per_id(dim: DataFrame, lead: str, *attributes: str, key: str = "id") -> DataFrame:
    """One row per id: the first by ``lead`` (blank last), then by the other attributes."""
    kept = dim.select(key, *[blank_to_null(c).alias(c) for c in (lead, *attributes)])
    row = F.struct(lead, *attributes)
    order = F.struct(
        F.col(lead).isNull(), *[F.coalesce(F.col(c), F.lit("")) for c in (lead, *attributes)]
    )
    first = kept.groupBy(key).agg(F.min_by(row, order).alias("_row")).select(key, "_row.*")
    return marked_unique(first, key)


def unique_by_id(dim: DataFrame, key: str = "id") -> DataFrame:
    """One whole row per id: the first by the other columns in their order, NULL last. The choice
    does not depend on which columns a job reads. Rows without an id match nothing and drop out. A
    dimension with the mark is taken as it is."""
    if is_unique(dim, key):
        return dim.where(F.col(key).isNotNull())
    rest = [c for c in dim.columns if c != key]
    order = F.struct(*[x for c in rest for x in (F.col(c).isNull(), F.col(c))])
    first = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return marked_unique(first.select(key, "_row.*"), key)


def with_attributes(
    fact: DataFrame, dim: DataFrame, on: str, columns: dict[str, str | Column], key: str = "id"
) -> DataFrame:
    """Left join ``dim``, one row per id, on ``fact[on] = dim[key]`` and add ``columns`` (new name ->
    source). A repeated id never repeats rows of ``fact``."""
    source = {name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()}
    right = unique_by_id(dim, key).select(F.col(key).alias("_key"), *[c.alias(name) for name, c in source.items()])
    return fact.join(right, fact[on] == right["_key"], "left").drop("_key")


def named_or_id(name: str, identifier: str) -> Column:
    """Looked-up name, else ``ID: <id>``."""
    return F.coalesce(
        F.col(name),
        F.concat(F.lit("ID: "), F.coalesce(F.col(identifier).cast("string"), F.lit("None"))),
    )
