"""From documents to packed training sequences: each stage is written and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import lines, mixing, near, packing, quality
from corrobora.session import shared_folder

POLICY = "v1"
SHINGLE_WORDS = 5
"""Near copies share 0.8 or more of their shingles of five words."""

MIX_SEED = 20
END_ID = 1
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the policy."""
    return quality.ledger(docs).filter(quality.keeps(POLICY)).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three documents or more share; documents left without any word go."""
    kept = lines.deduplicated(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by SimHash and, as it misses many copies at 0.8, by similarity."""
    return near.representatives(docs, words=SHINGLE_WORDS, by_simhash=True).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated toward the target weights of their sources; copies are repeated rows."""
    return mixing.mixed(docs, MIX_SEED).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(docs, path, spaced=False, end_id=END_ID)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_shared_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

ORACLE_SQL = None
"""Tokenizers, SimHash and packing have no SQL; the pipeline is tested against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
