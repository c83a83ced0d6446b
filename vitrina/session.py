"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings. Joins carry no broadcast hints: a side is broadcast only when
# its estimated or (through AQE) measured size is under the threshold, and falls back to
# a sort-merge join with skew splitting beyond it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
}


#: Shuffled bytes that one task should get: a few times less than its share of executor memory.
TASK_BYTES = 128 << 20


def shuffle_width(input_bytes: int, shuffled_share: float = 0.5, task_bytes: int = TASK_BYTES) -> int:
    """Partitions before adaptive merging: the shuffled part of the input over the bytes of a task,
    and 200 at least. Adaptive execution merges partitions that turn out small but never adds any to
    an aggregation, so the first number has to fit the input: 400,000 for 100 TB."""
    return max(200, -(-int(input_bytes * shuffled_share) // task_bytes))


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to an existing session; ``input_bytes`` sizes its shuffles."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_width(input_bytes)))
    return spark


def local_session(cpus: str = "*", memory: str = "8g", app: str = "vitrina") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    builder = builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh subfolder of the one that all executors share (``spark.checkpoint.dir``). Only a
    session in local mode, where everything runs in one process, gets a local one without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base}/{label}-{uuid.uuid4().hex}"
