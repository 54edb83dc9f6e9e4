"""The operators bound to the given tables, with checking SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import fingerprints, importance, infill, lines, mixing, packing, pii, quality, search, simhash, token_counts, tokenfile, urls
from corrobora.llm import sql as oracle
from corrobora.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

MIX_SEED = 20
MIX_TEMPERATURE = 0.5
WORD_IDS = "word_bpe_49k.json"
BYTE_IDS = "byte_bpe_50k.json"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.deduplicated(documents(spark, folder).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), public_tokenizers.path(WORD_IDS), spaced=False, end_id=1)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokenfile.write(documents(spark, folder), files, public_tokenizers.path(WORD_IDS), spaced=False, end_id=2)
    return tokenfile.digests(spark, files)


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return token_counts.counted(docs, public_tokenizers.path(BYTE_IDS), spaced=True, limit=512)


def exact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = search.quantised(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return search.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.grouped(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = quality.ledger(documents(spark, folder).select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.keeps("base")).alias("base_failed"), quality.keeps("v1").alias("kept"), "fail_bits",
    )


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(documents(spark, folder).select("doc_id", "text"))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *counts, F.sha2(pii.places(base), 256).alias("base_sha256"), pii.places(F.col("spans")).alias("spans")
    )


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder), MIX_SEED, temperature=MIX_TEMPERATURE)


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compared(documents(spark, folder))


def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.arranged(documents(spark, folder), seed=1, rate=90, spm_rate=20))


def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    return importance.resampled(documents(spark, folder), target, seed=7, percent=25, min_words=20)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": line_dedup,
    "op2_best_fit_packing": best_fit_packing,
    "op3_token_files": token_files,
    "op4_token_counts": token_count,
    "op5_exact_top_k": exact_search,
    "op6_simhash_near_dedup": simhash_groups,
    "op7_quality_rules": quality_rules,
    "op8_pii": personal_data,
    "op9_url_filters": url_filter,
    "op10_source_mixing": source_mixing,
    "op11_document_fingerprints": document_fingerprints,
    "op12_fill_in_middle": fill_in_middle,
    "op13_importance_resampling": importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": oracle.LINE_DEDUP,
    "op7_quality_rules": oracle.QUALITY_RULES,
    "op9_url_filters": oracle.URL_FILTERS,
    "op10_source_mixing": oracle.SOURCE_MIXING,
    "op11_document_fingerprints": oracle.FINGERPRINTS,
    "op12_fill_in_middle": oracle.INFILL,
    "op13_importance_resampling": oracle.IMPORTANCE,
}
