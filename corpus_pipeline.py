"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and gives the rows it kept, with the columns of
``documents``; the last gives token ids. ``run`` writes every stage's rows to the shared folder and
reads them back as the next one's input, so a lost executor costs one stage's tasks at most; a
stage's rows are deleted once the next one's are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import bpe, mixing, pii, quality, simhash
from vitrina.llm.common import discard, fresh_name, stored, table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language."""
    out = fresh_name(docs, "quality")
    return quality.judge_documents(docs, out=out).filter(F.col(out)["kept"]).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose fingerprints (three-word shingles) link within 2 bits."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and ``n_chars`` (where present) brought up to date."""
    masked = pii.mask_private(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, at their source's rate, in a global shuffle."""
    return mixing.mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed little-endian unsigned 32-bit integers), and the digest of
    the bytes they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    ids = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.token_bytes(spark, F.col("token_ids"), ranks, public_tokenizers.PATTERN)
    return ids.drop("text").withColumn("decoded", decoded).select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express fingerprints, deobfuscation or merges; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), "pipeline")
        if read is not None:
            discard(spark, read)
        read = path
    return docs
