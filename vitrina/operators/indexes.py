"""Stored indexes of a catalogue: trigrams for search by contained text, ranges for pages by number."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.operators.filters import containing_any

#: Rows of a block (by id) and of a range (by order): what a lookup reads at least.
BLOCK_IDS, RANGE_ROWS = 1_000_000, 100_000
#: Rows of a folder of ranges at least.
FOLDER_ROWS = 100_000
#: Folders that the trigrams are dealt to.
BUCKETS = 64

#: Text wanted in any of some columns.
Condition = tuple[list[str], str]


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for a shorter text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    none = F.array().cast("array<string>")
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, 3)))).otherwise(none)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TrigramIndex:
    """Rows by block of ids, and for every (column, trigram) the texts of each block that hold it."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, df: DataFrame, columns: list[str], path: str, identifier: str = "id", block: int = BLOCK_IDS) -> TrigramIndex:
        """Write the rows of ``df``, once, and the trigrams of the texts in ``columns``: those of a text once per block,
        however many rows of the block hold it. The texts are read back from the stored rows. Ids are whole numbers;
        rows of one id are found together and then told apart by the condition itself."""
        rows = df.withColumn("bloque", F.floor(F.col(identifier) / block).cast("bigint"))
        rows.hint("rebalance", "bloque").write.mode("overwrite").partitionBy("bloque").parquet(f"{path}/filas")
        stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/filas").where(F.col("bloque").isNotNull())
        texts = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("texto")) for c in columns]))
        each = stored.select("bloque", texts.alias("t")).select("bloque", "t.*").where(F.length("texto") >= 3).distinct()
        # A text is named by its hash: texts of one hash make a block a candidate too often, never too seldom.
        grams = each.select("columna", F.explode(trigrams(F.col("texto"))).alias("trigrama"), "bloque", F.xxhash64("texto").alias("clave"))
        spread = grams.withColumn("cubeta", _bucket(F.col("trigrama"))).hint("rebalance", "cubeta", "trigrama")
        spread.sortWithinPartitions("cubeta", "trigrama", "columna", "bloque").write.mode("overwrite").partitionBy("cubeta").parquet(f"{path}/trigramas")
        return cls(df.sparkSession, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/filas")

    def needles(self, text: str) -> list[str]:
        """Trigrams that every text containing ``text`` holds: those of its parts between wildcards."""
        parts = [p for p in re.split(r"[%_\\]+", text) if len(p) >= 3]
        if not parts:
            return []
        found = self.spark.range(1).select(F.array_distinct(F.flatten(F.array(*[trigrams(F.lit(p)) for p in parts]))))
        return list(found.first()[0])

    def candidates(self, condition: Condition) -> DataFrame | None:
        """``bloque`` of the blocks with a text that can meet a condition; None where its text has no trigram."""
        columns, text = condition
        wanted = self.needles(text)
        if not wanted:
            return None
        grams = self.spark.read.parquet(f"{self.path}/trigramas")
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "g string").select(_bucket(F.col("g"))).distinct().collect()]
        picked = grams.where(F.col("cubeta").isin(buckets) & F.col("trigrama").isin(wanted) & F.col("columna").isin(columns))
        held = picked.groupBy("bloque", "columna", "clave").agg(F.countDistinct("trigrama").alias("n")).where(F.col("n") == len(wanted))
        return held.select("bloque").distinct()

    def search(self, conditions: list[Condition]) -> DataFrame:
        """Rows that contain each text in any of its columns, as a scan would find them: the trigrams name the blocks
        that hold such texts, only those are read, and the condition itself picks their rows. Texts without a part
        of three characters narrow nothing; if no text does, the rows are scanned."""
        found = [c for c in map(self.candidates, conditions) if c is not None]
        rows = self.rows()
        if found:
            held = reduce(lambda a, b: a.join(b, "bloque", "left_semi"), found)
            blocks = [r[0] for r in held.collect()]  # at most the folders of the rows
            rows = rows.where(F.col("bloque").isin(blocks)) if blocks else rows.where(F.lit(False))
            # The limit is the number of blocks: it takes none away and tells the planner that the side is small.
            rows = rows.join(held.limit(len(blocks)), "bloque", "left_semi")
        return reduce(lambda df, c: df.where(containing_any(*c)), conditions, rows).drop("bloque")


@dataclass(frozen=True)
class PageIndex:
    """Rows in ranges of the listing's order, with the number of rows of each range. Ranges lie together in folders
    (``tramo``) of ``FOLDER_ROWS`` rows or of one range, whichever is more, and are numbered in them (``parte``): what
    the driver hears of (samples, tasks, files) goes by folders."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    newest_first: bool

    @classmethod
    def build(
        cls, df: DataFrame, columns: list[str], path: str, newest_first: bool = True, rows: int = RANGE_ROWS
    ) -> PageIndex:
        """Write ``df`` in ranges of ``rows`` rows by ``columns``, which tell rows apart; the last range of a folder
        may hold fewer. A file keeps its ranges in order, in pages of about a range, so that a reader skips the others."""
        index = cls(df.sparkSession, path, tuple(columns), newest_first)
        folders = max(1, -(-df.count() // max(rows, FOLDER_ROWS)))
        placed = df.repartitionByRange(folders, *index.order()).sortWithinPartitions(*index.order())
        # The low 33 bits of the id are the place in the partition, which holds the rows of a folder in order.
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        placed = placed.withColumns({"parte": F.floor(place / rows).cast("int"), "tramo": F.spark_partition_id()})
        ordered = placed.sortWithinPartitions("tramo", "parte", *index.order())
        ordered.write.mode("overwrite").option("parquet.page.row.count.limit", rows).partitionBy("tramo").parquet(f"{path}/filas")
        stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/filas")
        stored.groupBy("tramo", "parte").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/conteos")
        return index

    def order(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if self.newest_first else F.col(c).asc_nulls_last() for c in self.columns]

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """A page by number: the counts tell the ranges it lies in, mostly one, and only those are read."""
        counts = self.spark.read.parquet(f"{self.path}/conteos")
        first = (number - 1) * size

        def touched(counts: DataFrame, unit: str, before: int) -> list[tuple[int, int]]:
            """The units in order that the page lies in, with the rows before them."""
            earlier = F.coalesce(F.sum("n").over(Window.orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            each = counts.groupBy(unit).agg(F.sum("n").alias("n")).withColumn("antes", earlier + before)
            hit = each.where((F.col("antes") < first + size) & (F.col("antes") + F.col("n") > first))
            return sorted((r[unit], r.antes) for r in hit.collect())

        # One row per folder of the table, then one per range of a folder; those of one page reach the driver.
        folders = touched(counts, "tramo", 0)
        rows = self.spark.read.parquet(f"{self.path}/filas")
        if not folders:
            return rows.where(F.lit(False)).drop("tramo", "parte")
        held = F.col("tramo").isin([t for t, _ in folders])
        before = folders[0][1]
        # Of the first and the last folder only some ranges are needed; those between are read whole.
        for (folder, start), first_one in ((folders[0], True), (folders[-1], False)):
            parts = touched(counts.where(F.col("tramo") == folder), "parte", start)
            if first_one:
                before = parts[0][1]
                held &= (F.col("tramo") != folder) | (F.col("parte") >= parts[0][0])
            else:
                held &= (F.col("tramo") != folder) | (F.col("parte") <= parts[-1][0])
        return rows.where(held).drop("tramo", "parte").orderBy(*self.order()).offset(first - before).limit(size)
