"""The operators bound to the benchmark tables, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import alignment, bpe, embedding_dedup, lexical, mixing, oracles, packing, pii, quality, secrets, simhash, suffix_dedup, url_filter, warc
from vitrina.llm.common import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long"))
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge_documents(docs).select("doc_id", "quality.*")
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    return ids.withColumn("decoded", bpe.token_bytes(spark, F.col("token_ids"), ranks, public_tokenizers.PATTERN)).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_private(docs).select("doc_id", "private.*")
    kinds = F.transform(F.split("base", ","), lambda s: F.substring_index(s, ":", 1))
    return found.select(
        "doc_id",
        *(F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.clearing_bins(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *(
            F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")
            for k, kind in enumerate(secrets.KINDS[:3])
        ),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("secrets")).alias("spans"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.align_documents(docs, a.read(), b.read())


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as words:
        cut = packing.pieces(docs, words.read())
    digest = F.crc32("ids").alias("ids_crc32")
    packed = packing.pack(cut.select("doc_id", "piece", "start", "length", digest, "part", "nth"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_warc, op3_url_filter, op4_quality_rules, op5_embedding_dedup, op6_byte_bpe, op7_mixing, op8_pii, op9_simhash, op10_secrets, op11_lexical_search, op12_token_alignment, op13_packing)
}
ORACLES: dict[str, str] = {"op3_url_filter": oracles.OP3, "op7_mixing": oracles.OP7, "op11_lexical_search": oracles.OP11}
