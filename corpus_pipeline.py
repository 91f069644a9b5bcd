"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of ``documents``, and extra ones, under whatever names, as they are.

In every stage an empty table gives an empty result, very long texts are read whole, and rows are judged one by one: a row
without id, or one that repeats another's id, is kept or dropped by its own text. What each stage does with null texts and
repeated rows is stated there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldspark.llm.decontam import without_contaminated
from foldspark.llm.neardup import deduplicate
from foldspark.llm.pieces import encode_documents
from foldspark.llm.quality import keep_quality
from foldspark.llm.scratch import collected, cut, delete
from foldspark.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the positive-unlabelled classifier rejects. Null and empty texts are judged like others."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates (five words, similarity 0.8 or more), that of the smallest
    id; of repeated rows one stays. Null and blank texts are in no group and stay."""
    return deduplicate(docs, words=5, similarity=(80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one. Null and empty texts hold none."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by their kind, and set ``n_chars`` anew there. Null texts stay null."""
    return redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True).drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece", tokens_stage),
]

#: No stage but the last is plain SQL; run() is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's intermediate tables and its input go when its result is written; the table
    that the last one reads stays, as that stage runs with the caller's action."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with collected() as paths:
            docs = cut(stage(spark, docs, sf_dir), "stage")
        delete(spark, before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
