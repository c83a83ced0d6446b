"""Partitioned parquet tables that change in one commit.

``<path>/data/<partition>/version_id=<id>/`` holds the files, ``<path>/versions/<number>.json`` says which
version of each partition is current. New files are written beside the old ones, where no reader looks;
a commit is the appearance of one small file, moved into place under the next number. A reader takes the
highest number there is, so it sees all of a change or none of it, and a change that fails on the way
leaves files that nothing refers to. Two changes at once: the second finds its number taken and fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "version_id"


class CommitConflict(RuntimeError):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class Manifest:
    """A state of the table: its schema, the version of every partition (``anio=2024/mes=1``), and what its
    writer noted about the input."""

    number: int
    schema: StructType
    partitions: dict[str, str]
    log: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str
    partition_by: tuple[str, ...]

    @property
    def data(self) -> str:
        return f"{self.path.rstrip('/')}/data"

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the committed states, in order."""
        place, files = self._place("versions/*.json")
        found = (s.getPath().getName() for s in files.globStatus(place) or ())
        return sorted(int(name[:-5]) for name in found if name[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest | None:
        """A state by number, the current one by default; None before the first commit."""
        number = max(self.versions(), default=None) if number is None else number
        if number is None:
            return None
        place, files = self._place(f"versions/{number}.json")
        stream = files.open(place)
        try:
            said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(number, StructType.fromJson(said["schema"]), said["partitions"], said.get("log", {}))

    def read(self, number: int | None = None) -> DataFrame:
        """The table in its current state (or that of a number). Partition columns come from the folders, so
        filters on them prune what is read."""
        state = self.manifest(number)
        if state is None:
            raise FileNotFoundError(f"no committed table under {self.path}")
        if not state.partitions:
            return self.spark.createDataFrame([], state.schema)
        folders = [f"{self.data}/{partition}/{VERSION}={version}" for partition, version in sorted(state.partitions.items())]
        whole = StructType(state.schema.fields).add(VERSION, "string")
        return self.spark.read.schema(whole).option("basePath", self.data).parquet(*folders).drop(VERSION)

    def stage(self, df: DataFrame) -> dict[str, str]:
        """Write ``df`` where no reader looks; the partitions written and their version. A hot partition is
        split over several tasks, small ones share one."""
        version = uuid.uuid4().hex
        whole = df.withColumn(VERSION, F.lit(version)).hint("rebalance", *self.partition_by)
        whole.write.mode("append").partitionBy(*self.partition_by, VERSION).parquet(self.data)
        place, files = self._place(f"data/{'/'.join(f'{c}=*' for c in self.partition_by)}/{VERSION}={version}")
        written = {}
        for status in files.globStatus(place) or ():
            folders = status.getPath().toString().split("/")
            written["/".join(folders[-1 - len(self.partition_by) : -1])] = version
        return written

    def stored_schema(self, df: DataFrame) -> StructType:
        """Columns in the order they are read in: data columns, then partition columns."""
        return df.select([c for c in df.columns if c not in self.partition_by] + list(self.partition_by)).schema

    def commit(
        self, schema: StructType, partitions: dict[str, str], after: int, log: dict[str, str] | None = None
    ) -> int:
        """Make ``partitions`` the state that follows state ``after`` (0: the first)."""
        number = after + 1
        place, files = self._place(f"versions/{number}.json")
        staged, _ = self._place(f"versions/.{uuid.uuid4().hex}.tmp")
        out = files.create(staged, False)
        try:
            state = {"schema": schema.jsonValue(), "partitions": partitions, "log": log or {}}
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        if files.exists(place) or not files.rename(staged, place):
            files.delete(staged, False)
            raise CommitConflict(f"state {number} of {self.path} exists already")
        return number

    def replace(
        self,
        df: DataFrame,
        outdated: Callable[[dict[str, str]], bool],
        after: int | None = None,
        log: dict[str, str] | None = None,
    ) -> int:
        """One commit that takes out the partitions for which ``outdated`` holds (values as text) and puts
        those of ``df`` in; a partition of ``df`` replaces one of the same values. ``after`` is the state the
        caller worked from, by default the one current now; ``log`` replaces the log, which stays otherwise."""
        before = self.manifest(after or None)
        if after is None:
            after = before.number if before else 0
        written = self.stage(df)
        kept = {p: v for p, v in (before.partitions if before else {}).items() if not outdated(partition_values(p))}
        noted = (before.log if before else {}) if log is None else log
        state = (self.stored_schema(df), kept | written, after)
        return self.commit(*state, noted) if noted else self.commit(*state)

    def expire(self, keep: int = 2) -> int:
        """Delete files that none of the last ``keep`` states refers to; how many folders went. Not to be run
        while a change is being written."""
        states = [self.manifest(n) for n in self.versions()[-keep:]]
        live = {(p, v) for state in states for p, v in state.partitions.items()}
        place, files = self._place(f"data/{'/'.join(f'{c}=*' for c in self.partition_by)}/{VERSION}=*")
        gone = 0
        for status in files.globStatus(place) or ():
            folders = status.getPath().toString().split("/")
            if ("/".join(folders[-1 - len(self.partition_by) : -1]), folders[-1].split("=", 1)[1]) not in live:
                files.delete(status.getPath(), True)
                gone += 1
        for number in self.versions()[:-keep]:
            old, _ = self._place(f"versions/{number}.json")
            files.delete(old, False)
        return gone


def partition_values(partition: str) -> dict[str, str]:
    """Column values of a partition folder, as text."""
    return dict(re.findall(r"([^/=]+)=([^/]+)", partition))
