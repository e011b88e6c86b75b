"""Registry of this subpackage's queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import bpe, langid, licenses, lines, media, neardup, packing, secrets, shards, suffixes
from paneloom.session import Scratch, read_table


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = public_tokenizers
    return packing.pack(read_table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the compacted store, the number of versions that its arrivals made, and whether later versions merged shards."""
    _, rows, told = shards.compacted(read_table(spark, sf_dir, "documents"), Scratch(spark, "shards").root)
    merged = told["version"] > told["arrivals"] and sum(told["after"].values()) < sum(told["before"].values())
    return shards.digests(rows).withColumns({"arrivals": F.lit(told["arrivals"]).cast("bigint"), "compacted": F.lit(merged)})


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = public_tokenizers
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_packing": op1_hilbert_packing,
    "op2_media_chunks": op2_media_chunks,
    "op3_license_join": op3_license_join,
    "op4_language_families": op4_language_families,
    "op5_shard_compaction": op5_shard_compaction,
    "op6_parity_join": op6_parity_join,
    "op7_line_frequency": op7_line_frequency,
    "op8_secret_forest": op8_secret_forest,
    "op9_sparse_suffixes": op9_sparse_suffixes,
    "op10_bpe_chunks": op10_bpe_chunks,
}

ORACLES: dict[str, str] = {
    "op3_license_join": licenses.oracle_sql(),
    "op6_parity_join": neardup.oracle_sql(),
    "op7_line_frequency": lines.oracle_sql(),
    "op9_sparse_suffixes": suffixes.oracle_sql(),
    "op5_shard_compaction": f"SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, (SELECT count(DISTINCT coalesce(doc_id, 0) % {shards.ARRIVALS}) FROM documents) AS arrivals, true AS compacted FROM documents",
}
