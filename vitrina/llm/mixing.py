"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of the corpus; the mean repetition rate of its documents is that share
of all bytes over the bytes it has. A document's number of copies is a Poisson variable of that mean,
inverted from a hash of the seed and the document id, so reruns and lost executors give the same
copies. A mean over ``PART`` is drawn as a sum of independent parts. Copies are dealt to partitions and
ordered within them by a hash of document and copy, which shuffles the corpus globally.

Weights are given per source (sources left out get nothing), or follow the measured sizes to the power
``exponent`` (1: as they are, 0: all equal). Sizes are UTF-8 bytes of all documents.

Defined cases: a NULL source is a source of its own. NULL and empty texts count as one byte, so every
source has a size. Documents without an id share one draw, as do repeated rows of an id. An empty table
gives an empty result. Extra columns pass through; columns named like an output are replaced.
Everything is DataFrame functions; the source table is broadcast only while it has at most
``BROADCAST_SOURCES`` rows and joined by a shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 16.0
#: Terms of the distribution function that are tabled for a part: beyond them less than 1e-16 is left.
TERMS = 70
BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5) -> DataFrame:
    """``(source, rate)``: the mean number of copies of a document of each source."""
    size = F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    sizes = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").cast("double").alias("size"))
    if weights is None:
        share = F.pow("size", F.lit(exponent))
    else:
        named = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        share = F.coalesce(named[F.col("source")].cast("double"), F.lit(0.0))
    shared = sizes.withColumn("share", share)
    total = shared.agg(F.sum("size").alias("all"), F.sum("share").alias("shares")).first()
    if not total["shares"]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    return shared.select("source", (F.col("share") / total["shares"] * total["all"] / F.col("size")).alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the joined parts: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def distribution(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ...: how many values lie at or below a uniform
    number is the variable."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("at")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / (k + 1)).alias("p"),
            (acc["sum"] + acc["p"]).alias("sum"),
            F.concat(acc["at"], F.array(acc["sum"] + acc["p"])).alias("at"),
        ),
        lambda acc: acc["at"],
    )


def copies(docs: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """``docs`` with column ``copies``."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = rates.select(F.col("source").alias("_source"), parts.alias("_parts"), distribution(F.col("rate") / parts).alias("_at"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), table["_parts"]),
        F.lit(0),
        lambda acc, i: acc + F.transform(
            F.array(uniform(F.lit(seed), key, i.cast("string"))), lambda u: F.size(F.filter(table["_at"], lambda x: x <= u))
        )[0],
    )
    met = docs.drop("copies").join(table, docs["source"].eqNullSafe(table["_source"]))
    return met.select(docs.drop("copies")["*"], drawn.alias("copies"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, seed: str = "mix-1"
) -> DataFrame:
    """The mixed corpus: ``docs`` columns, ``replica`` (from 1) and ``place`` (the shuffle key)."""
    drawn = copies(docs, source_rates(docs, weights, exponent), seed).filter("copies > 0")
    each = drawn.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = each.withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), key, F.col("replica").cast("string"))))
    return placed.repartition("place").sortWithinPartitions("place")
