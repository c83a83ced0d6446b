"""Exported database views: JDBC export and CSV scan."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitrina.sources.ranges import fragments, joined, records, starts


def read_view(
    spark: SparkSession,
    url: str,
    view: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """View over JDBC, read in parallel ranges when a numeric column and its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=view, fetchsize=fetch_size, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """``columns`` of CSV files with a header, by name and as text; the cleaning jobs do the typing.
    Columns may stand in any order; files of one read share it, else the read fails. Line breaks
    inside quotes need ``multi_line``: quotes then stand only around fields, or doubled within, as
    ``write_csv`` writes them. Files are split in both cases. A column the files lack is NULL.
    ``_corrupt_record`` holds the text of a row with too many or too few fields."""
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnPruning", False)  # else a short row goes unnoticed when its last column is not read
    )
    header = reader.csv(path).columns  # the first line only; nothing is inferred
    schema = StructType([StructField(c, StringType()) for c in [*header, CORRUPT]])
    if multi_line:
        rows = _parsed(csv_records(spark, path, header), schema)
    else:
        rows = reader.option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False).schema(schema).csv(path)
    missing = [c for c in columns if c not in header]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*columns, CORRUPT)


def csv_records(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """``texto`` of every CSV record but the headers, which have to be ``header`` in every file. Records with
    line breaks stay whole, whichever byte ranges they lie in."""
    pieces = fragments(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    known = starts(pieces, quotes)

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, files = [], set()
        for file, start, part, text in records(batches, known, lambda v, first: v.count('"') % 2 == 1, "\n"):
            if part is None and start == 0 and file not in files:
                files.add(file)
                if next(csv.reader(io.StringIO(text.removeprefix("\ufeff")))) != header:
                    raise ValueError(f"header of {file} is not {header}")
            elif part is not None or text.rstrip("\r"):
                out.append((file, start, part, text))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_PART_COLUMNS)
                out = []
        yield pd.DataFrame(out, columns=_PART_COLUMNS)

    made = pieces.mapInPandas(assemble, "archivo string, inicio long, parte string, texto string")
    return made.where("parte IS NULL").select("texto").unionByName(joined(made.where("parte IS NOT NULL"), "\n"))


_PART_COLUMNS = ["archivo", "inicio", "parte", "texto"]


def _parsed(found: DataFrame, schema: StructType) -> DataFrame:
    options = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
    text = F.regexp_replace("texto", r"\r$", "")
    return found.select(F.from_csv(text, F.lit(schema.toDDL()), options).alias("r")).select("r.*")


def corrupt_rows(rows: DataFrame) -> DataFrame:
    """One row: how many rows were read and how many had the wrong number of fields."""
    # The reader wants a second column to be read beside the corrupt text.
    corrupt = F.col(CORRUPT).isNotNull() | (F.length(rows.columns[0]) < 0)
    return rows.agg(F.count(F.lit(1)).alias("leidas"), F.count_if(corrupt).alias("corruptas"))
