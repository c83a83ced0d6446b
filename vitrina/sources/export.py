"""Report bundles: several result frames written side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


def write_report(frames: Mapping[str, DataFrame], path: str, file_format: str = "csv") -> None:
    """One folder per result under ``path``, as CSV with a header or as parquet."""
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite")
        if file_format == "csv":
            writer = writer.option("header", True)
        writer.format(file_format).save(f"{path.rstrip('/')}/{name}")


def write_ops_report(
    reps: DataFrame, derived: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, name: str = "promotores"
) -> None:
    """The rep report and what is derived from it. The rep report is written once, as parquet, and
    everything else is built from what was written, so the visits are scanned once."""
    stored = f"{path.rstrip('/')}/{name}"
    reps.write.mode("overwrite").parquet(stored)
    written = reps.sparkSession.read.schema(reps.schema).parquet(stored)
    write_report({key: job(written) for key, job in derived.items()}, path, "parquet")
