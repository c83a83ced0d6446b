"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that is not the smallest of its component.

    Each round points larger neighbours at the smallest neighbour of a node and then smaller ones at
    the smallest of those, until only stars around the smallest nodes are left. Minima are combined
    map-side and a star with very many leaves meets its minimum in a join whose hot side adaptive
    execution can split. Rounds are cut by tables in the shared folder; only their row count and
    checksum reach the driver. Self loops and NULL ends are ignored; repeated edges count once; an
    empty table gives an empty result.
    """
    spark = edges.sparkSession
    current, path = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
            .select("col.u", "col.v")
            .filter("u <> v")
            .distinct()
        )
        following, next_path = stored(small, "edges")
        mark = following.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(spark, path)
        current, path = following, next_path
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
