"""A training-data pipeline over documents: language, near duplicates, repeated passages, secrets, packing.

Each stage works on all that its predecessor kept and returns the columns of documents; the last returns packed
pieces. ``run`` writes every stage's result to the shared folder and reads it again, so a lost executor costs
the work of one stage at most.

* language: documents whose language can't be told go: those without a letter, and those on which the machines' votes
  are little better than coin flips (``langid.LEAST_SCORE``). ``lang`` becomes the predicted language of the others.
* near_duplicates: of each group linked by a Jaccard similarity of 0.8 of five-word shingles one document stays.
* repeated_passages: later occurrences of passages of 50 words or more are cut from the texts; a document left
  without a word goes.
* secrets: secrets are replaced by a mark; no document goes.
* packing: sequences of 2,048 tokens along a Hilbert curve.

Null texts, empty tables, repeated rows and extra columns are treated as the operators' own notes say; columns
beyond those of documents are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import langid, neardup, packing, secrets, suffixes
from paneloom.session import Scratch, clear_scratch, mark_scratch, read_table, release_shuffles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffixes.remove_repeats(docs.select(*COLUMNS)).where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = public_tokenizers
    return packing.pack(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secret_scan),
    ("packing", pack),
]

# The forest, the machines and the tokenizer cannot be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. What a stage wrote for itself, and its predecessor's result, go when its own is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = mark_scratch(spark)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        clear_scratch(spark, mark)
        if before is not None:
            scratch.drop(before)
        before = docs
        release_shuffles(spark)
    return docs
