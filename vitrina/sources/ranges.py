"""Records of text files whose separator may also stand inside quotes, read in byte ranges.

Spark's text reader cuts a file into byte ranges and gives the fragments between separators. Whether a
range begins inside quotes follows from the quotes of all ranges before it: one pass counts them per
range, a prefix sum over the ranges of a file tells each where it starts, and a second pass puts the
fragments of a record together. A record over several ranges leaves them as parts, which are joined on
their own; there are at most two per range. The driver holds a row per range, as the file index does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fragments(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """``(value, archivo, inicio)``: what lies between separators, in file order within a byte range; a range
    is told by its file and first byte."""
    raw = spark.read.option("lineSep", separator).text(path)
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    return raw.select(
        text.alias("value"), F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("inicio")
    )


@dataclass(frozen=True)
class Start:
    """What is known where a range begins: whether it is inside quotes, and the last mark before it."""

    inside: bool
    mark: str | None


def starts(
    pieces: DataFrame, quotes: Column, mark: Column | None = None, unpaired: frozenset[str] = frozenset()
) -> dict[tuple[str, int], Start]:
    """The start of every byte range, from the number of ``quotes`` of its fragments and the last ``mark`` in it
    (a text, NULL in fragments without one). The first fragments of the files ``unpaired`` hold one quote
    more than they open or close."""
    mark = F.lit(None).cast("string") if mark is None else mark
    each = pieces.select(
        "archivo", "inicio", quotes.alias("quotes"), mark.alias("mark"), F.monotonically_increasing_id().alias("place")
    )
    ranges = (
        each.groupBy("archivo", "inicio")
        .agg(
            (F.sum("quotes") % 2).alias("odd"),
            F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("place"))).alias("mark"),
        )
        .orderBy("archivo", "inicio")
        .collect()
    )
    known, file = {}, None
    inside, last = False, None
    for r in ranges:
        if r.archivo != file:
            file, inside, last = r.archivo, False, None
            known[file, r.inicio] = Start(False, None)
            inside = bool(r.odd) != (file in unpaired)
        else:
            known[file, r.inicio] = Start(inside, last)
            inside ^= bool(r.odd)
        last = r.mark if r.mark is not None else last
    return known


#: A record, or a part of one: file, first byte of the range, part and text. Parts are "cola" (a record
#: that begins in the range and goes on), "medio" (a range within one record) and "cabeza" (its end).
Record = tuple[str, int, str | None, str]


def records(
    batches: Iterator[pd.DataFrame], known: dict[tuple[str, int], Start], odd: Callable[[str, bool], bool], separator: str
) -> Iterator[Record]:
    """The records of a task's fragments, in order. ``odd``: whether a fragment has an odd number of quotes, told
    whether it is the first of its file."""
    now: tuple[str, int] | None = None
    held: list[str] = []
    inside = ended = False  # inside quotes; the record before this range has ended

    def rest() -> Iterator[Record]:
        if held:
            yield (*now, "cola" if ended else "medio", separator.join(held))

    for batch in batches:
        for value, file, start in zip(batch["value"], batch["archivo"], batch["inicio"]):
            first = start == 0 and (file, start) != now
            if (file, start) != now:
                yield from rest()
                now, held = (file, start), []
                inside = known[now].inside
                ended = not inside
            held.append(value)
            inside ^= odd(value, first)
            if not inside:
                yield (file, start, None if ended else "cabeza", separator.join(held))
                held, ended = [], True
    yield from rest()


def joined(parts: DataFrame, separator: str, *carried: str) -> DataFrame:
    """Records over several ranges from their parts ``(archivo, inicio, parte, texto)``: ``(texto, *carried)``, the
    latter from the part that begins the record."""
    in_file = Window.partitionBy("archivo").orderBy("inicio", F.col("parte") != "cabeza")
    chained = parts.withColumn("cadena", F.sum((F.col("parte") == "cola").cast("int")).over(in_file))
    pieces = F.array_sort(F.collect_list(F.struct("inicio", "texto")))
    first = [F.max(F.when(F.col("parte") == "cola", F.col(c))).alias(c) for c in carried]
    whole = chained.groupBy("archivo", "cadena").agg(pieces.alias("trozos"), *first)
    return whole.select(F.array_join(F.transform("trozos", lambda t: t["texto"]), separator).alias("texto"), *carried)
