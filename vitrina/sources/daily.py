"""Facts kept by day and rebuilt only for the days whose source rows changed.

The log of the days taken in is part of the table's manifest: per day the number of source rows and a
checksum of them, so data and log change in one commit. Finding changed days reads the columns the job uses
once and shuffles a row per day and task; rebuilding them reads those days alone, because the days go
into the scan as a filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators.filters import between_days
from vitrina.sources.versions import VersionedTable

#: Folder value of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
PIECE_BITS = 21


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the state it left, the days built anew and the days taken out."""

    number: int
    rebuilt: tuple[str, ...]
    removed: tuple[str, ...]


def daily_table(spark: SparkSession, path: str, day: str = "dia") -> VersionedTable:
    return VersionedTable(spark, path, (day,))


def day_marks(source: DataFrame, day: str) -> DataFrame:
    """``(day, marca)``: rows and checksum of each day. The checksum is the sum of the rows' hashes, kept as
    three sums of 21 bits so that none can overflow; it does not depend on the order or the placement of
    rows, and repeated rows count. A NULL is told from a value moved to the next column."""
    columns = source.columns
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    mask = (1 << PIECE_BITS) - 1
    pieces = [F.shiftrightunsigned("_hash", PIECE_BITS * i).bitwiseAND(mask) for i in range(3)]
    return (
        source.select(F.col(day).alias("dia"), row.alias("_hash"))
        .groupBy("dia")
        .agg(F.concat_ws(":", F.count(F.lit(1)), *[F.sum(p) for p in pieces]).alias("marca"))
    )


def of_days(source: DataFrame, column: str, days: list[date | None]) -> DataFrame:
    """Rows of the listed days. The days are literals: they prune partitions and row groups."""
    known = [d for d in days if d is not None]
    wanted: Column = F.col(column).isin(known) if known else F.lit(False)
    return source.where(wanted | F.col(column).isNull() if None in days else wanted)


def _folder(day: date | None) -> str:
    return NO_DAY if day is None else day.isoformat()


def refresh_days(
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    day: str,
    key: str = "dia",
    start: date | str | None = None,
    end: date | str | None = None,
    stale: Callable[[DataFrame], DataFrame] | None = None,
) -> Refresh:
    """Bring the table under ``path`` up to date with ``source`` in one commit.

    ``build`` makes the facts of whole days from their source rows; a row of its result belongs to the day of
    its source rows (DATE column ``day`` of the source, ``key`` of the result). ``source`` should hold the
    columns that ``build`` reads and no others: a change elsewhere rebuilds nothing. Days without source rows
    leave the table. With ``start`` and ``end`` only those days are looked at, the others stay as they are, and
    rows without a day are looked at only where no bound is given. ``stale`` names further days to rebuild: it
    gets the stored facts and returns a frame with their ``key`` (attributes that changed in a dimension, say).
    A changed schema of the facts rebuilds every day, which a bounded refresh refuses. The days go through
    the driver, a row each; facts do not."""
    table = daily_table(source.sparkSession, path, key)
    before = table.manifest()
    bounded = start is not None or end is not None
    marks = {r.dia: r.marca for r in day_marks(between_days(source, day, start, end), day).collect()}
    facts = build(source)
    same = before is not None and before.schema.simpleString() == table.stored_schema(facts).simpleString()
    if bounded and before is not None and not same:
        raise ValueError(f"the facts of {path} have other columns now: refresh all days")
    log = before.log if same else {}

    def looked_at(folder: str) -> bool:
        if folder == NO_DAY:
            return not bounded
        return (start is None or folder >= str(start)) and (end is None or folder <= str(end))

    changed = {d for d, mark in marks.items() if log.get(_folder(d)) != mark}
    if stale is not None and same:
        stored = between_days(table.read(before.number), key, start, end)
        changed |= {r[0] for r in stale(stored).select(key).distinct().collect()} & marks.keys()
    present = {_folder(d) for d in marks}
    known = set(before.log) if before is not None else set()
    removed = {f for f in known if looked_at(f) and f not in present}
    if same and not changed and not removed:
        return Refresh(before.number, (), ())

    # Unbounded and all days changed: no filter to evaluate.
    whole = not bounded and len(changed) == len(marks)
    taken = build(source if whole else of_days(source, day, sorted(changed, key=_folder)))
    renewed = {_folder(d) for d in changed}
    number = table.replace(
        taken,
        lambda values: not same or values[key] in renewed or values[key] in removed,
        after=before.number if before is not None else 0,
        log={f: mark for f, mark in log.items() if f not in removed} | {_folder(d): marks[d] for d in changed},
    )
    return Refresh(number, tuple(sorted(renewed)), tuple(sorted(removed)))

