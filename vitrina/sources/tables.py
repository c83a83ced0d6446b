"""Tables by logical name over a base folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from vitrina.operators.lookups import unique_by_id
from vitrina.schemas import SCHEMAS


@dataclass(frozen=True)
class Tables:
    """``<base>/<folder>/<name>.parquet``. A named folder (one per client) is read as is;
    otherwise the folders are tried in order."""

    spark: SparkSession
    base: str
    folders: tuple[str, ...] = ("global",)

    def path(self, name: str, folder: str) -> str:
        return f"{self.base.rstrip('/')}/{folder}/{name}.parquet"

    def read(self, name: str, client: str | None = None) -> DataFrame:
        return self._first(name, client, lambda path: self._scan(name, path))

    def dimension(self, name: str, client: str | None = None) -> DataFrame:
        """A dimension by its own schema, which says whether it holds one row per id (``write_dimension``)."""
        return self._first(name, client, self.spark.read.parquet)

    def _first(self, name: str, client: str | None, scan: Callable[[str], DataFrame]) -> DataFrame:
        candidates = [client] if client else list(self.folders)
        for folder in candidates:
            try:
                return scan(self.path(name, folder))
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
        raise FileNotFoundError(f"table {name!r} not found under {self.base} in {candidates}")

    def write_dimension(self, dim: DataFrame, name: str, folder: str | None = None) -> None:
        """Store a dimension with one row per id, once, at ingest."""
        write_dimension(dim, self.path(name, folder or self.folders[0]))

    def _scan(self, name: str, path: str) -> DataFrame:
        return read_parquet(self.spark, path, name)

    def register(self, *names: str, client: str | None = None) -> None:
        """Temp views of the same names, for use from SQL."""
        for name in names:
            self.read(name, client).createOrReplaceTempView(name)


def write_dimension(dim: DataFrame, path: str, key: str = "id") -> None:
    """Overwrite a dimension with one row per ``key``; its file says so, and jobs that read it skip the
    grouping."""
    write_parquet(unique_by_id(dim, key), path)


def read_parquet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Scan with the declared schema when the logical name has one."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a table. A partitioned table is rebalanced on its partition columns first:
    small partitions share a task and a hot one is split over several files. With dynamic
    overwrite only the partitions present in ``df`` are replaced."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)

