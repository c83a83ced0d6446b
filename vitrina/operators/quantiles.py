"""Exact per-group quantiles without gathering a group in one task."""

from __future__ import annotations

from functools import reduce
from math import isfinite
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a value range is cut into per pass, and the ranges that may be cut in all.
BINS, MOST_RANGES, MOST_PARTS = 4096, 200, 10_000
SLICES = 64
# Distinct values of a group that one slice should hold; more rows than this make more slices.
SLICE_VALUES = 4_000_000


def slices_for(distinct_values: int) -> int:
    """Slices for a group of so many distinct values: the sorted part of one task stays bounded."""
    return max(SLICES, -(-distinct_values // SLICE_VALUES))


def _slice_of(first: int, last: int) -> Column:
    """How many of the ordered cuts are at most ``v``, by halving ``cuts[first:last]``."""
    if first == last:
        return F.lit(first)
    middle = (first + last) // 2
    left, right = _slice_of(first, middle), _slice_of(middle + 1, last)
    return F.when(F.col("v") < F.col("cuts")[middle], left).otherwise(right)


def _position(p: float) -> Column:
    return F.col("n").cast("double") * F.lit(p) - F.lit(p)


def _holds(rank: Column, first: Column, last: Column) -> Column:
    return (first <= rank) & (rank <= last)


def _interpolated(found: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles from ``n`` and the values ``low_i`` and ``high_i`` at the ranks around each position."""

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"low_{i}"), F.col(f"high_{i}")
        return low + (high - low) * (_position(p) - F.floor(_position(p)))

    return found.select(*keys, *[between(i, p).alias(name) for i, (name, p) in enumerate(quantiles.items())])


def _part_of(ranges: list[tuple[float, float]]) -> Column:
    """The part that ``v`` falls into: that of the last of ``ranges`` to hold it, later ones lying within
    parts of earlier ones. The part within a range never falls as ``v`` rises."""
    v, part = F.col("v"), None
    for number, (low, high) in reversed(list(enumerate(ranges))):
        within = F.least(F.floor((v - low) / F.lit(high - low) * BINS), F.lit(BINS - 1)) + number * BINS
        inside = v.between(low, high)
        part = F.when(inside, within) if part is None else part.when(inside, within)
    return F.lit(0).cast("bigint") if part is None else part


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group with non-null keys, as doubles.
    ``weight`` names a count of equal rows, for input that is already collapsed.

    Rank selection by histograms: the range of all values is cut into ``BINS`` parts, the rows of each
    group and part are counted, and running sums tell the parts that hold the wanted ranks. Those are cut
    again, from their smallest to their largest value, until each holds one value. A pass counts all rows
    anew, in whole parts where no rank lies, so ranks need no carrying over and rows are never joined or
    sorted: only counts leave a task, at most ``BINS`` per group and refined part. The passes run when the
    quantiles are asked for; the driver holds the refined ranges and the parts with wanted ranks, at most
    two per group and quantile. Where those are more than ``MOST_RANGES`` and ``MOST_PARTS`` (very many
    groups), or values are infinite, values are sliced instead.
    """
    size = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), size.alias("c"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    ranks = [edge(_position(p)) for p in quantiles.values() for edge in (F.floor, F.ceil)]
    ranges = [(low, high)] if low is not None and low < high else []
    while True:
        if len(ranges) > MOST_RANGES or not all(isfinite(high - low) for low, high in ranges):
            return sliced_quantiles(df, keys, value, quantiles, weight)
        part = _part_of(ranges)
        parts = rows.groupBy(*keys, part.alias("part")).agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        ordered = Window.partitionBy(*keys).orderBy("low")
        placed = parts.withColumns({"upto": F.sum("c").over(ordered), "n": F.sum("c").over(Window.partitionBy(*keys))})
        first, last = F.col("upto") - F.col("c"), F.col("upto") - 1
        wanted = placed.where(reduce(or_, [_holds(r, first, last) for r in ranks]))
        few = wanted.limit(MOST_PARTS + 1).collect()
        if len(few) > MOST_PARTS:
            return sliced_quantiles(df, keys, value, quantiles, weight)
        refined: dict[int, tuple[float, float]] = {}
        for r in few:
            if r.low < r.high:
                least, most = refined.get(r.part, (r.low, r.high))
                refined[r.part] = min(least, r.low), max(most, r.high)
        if not refined:
            break
        ranges += refined.values()

    def at(rank: Column) -> Column:
        return F.max(F.when(_holds(rank, first, last), F.col("low")))

    last_parts = df.sparkSession.createDataFrame(few, wanted.schema)
    found = last_parts.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[at(F.floor(_position(p))).alias(f"low_{i}") for i, p in enumerate(quantiles.values())],
        *[at(F.ceil(_position(p))).alias(f"high_{i}") for i, p in enumerate(quantiles.values())],
    )
    return _interpolated(found.where(reduce(and_, [F.col(k).isNotNull() for k in keys])), keys, quantiles)


def sliced_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    weight: str | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """``exact_quantiles`` for any number of groups. ``slices`` should grow with the distinct values of the
    largest group (``slices_for``).

    1. Rows collapse to (group, value, count): repeated values cost nothing further.
    2. The distinct values of a group are cut into ``slices`` of about equal size. The cuts come
       from an approximate pass; they only have to be any cuts for the result to be exact.
    3. A running sum over slice totals finds the slice of each wanted rank, and a running sum over
       the values of just those slices finds the value.
    """
    probs = list(quantiles.values())
    rows = df.where(F.col(value).isNotNull())
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(size.alias("c"))

    slices = max(slices, 2)
    steps = [i / slices for i in range(1, slices)]
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx("v", steps).alias("cuts"), F.sum("c").alias("n")
    )
    sliced = counts.join(cuts, keys).select(
        *keys,
        "v",
        "c",
        "n",
        _slice_of(0, slices - 1).alias("slice"),
    )

    ranks = [edge(_position(p)) for p in probs for edge in (F.floor, F.ceil)]
    totals = sliced.groupBy(*keys, "slice").agg(F.sum("c").alias("t"), F.max("n").alias("n"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("slice"))
    wanted = (
        totals.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("t"))
        .where(reduce(or_, [_holds(r, F.col("before"), F.col("upto") - 1) for r in ranks]))
        .select(*keys, "slice", "before")
    )
    running = F.sum("c").over(Window.partitionBy(*keys, "slice").orderBy("v"))
    ranked = (
        sliced.join(wanted, [*keys, "slice"])
        .withColumn("last", F.col("before") + running - 1)
        .withColumn("first", F.col("last") - F.col("c") + 1)
    )

    def at(rank):
        return F.max(F.when(_holds(rank, F.col("first"), F.col("last")), F.col("v")))

    found = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[at(F.floor(_position(p))).alias(f"low_{i}") for i, p in enumerate(probs)],
        *[at(F.ceil(_position(p))).alias(f"high_{i}") for i, p in enumerate(probs)],
    )

    return _interpolated(found, keys, quantiles)
