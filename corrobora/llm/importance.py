"""Importance resampling toward a target: hashed n-gram gains score documents, the highest perturbed scores are drawn.

The corpus and the target are counted in arrays of ``N_BUCKETS`` hashed features; a document's weight is the mean gain of its
features, looked up in one array. A Gumbel number from a hash of the document is added, so the highest scores are a draw
without replacement in proportion to the weights. The cutoff is found by numeric bisection over the stored scores:
every job counts exactly how many rows reach each of ``SECTIONS`` thresholds. Only the drawn rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.ordering import rank_in_group
from corrobora.session import scratch_path

N_BUCKETS = 10_000
ORDER = 2
"""Words in the longest feature."""

SECTIONS = 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text: str | None, order: int = ORDER, n_buckets: int = N_BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every feature, repeats included.

    A-Z are lower-cased; words are runs of digits, letters a-z and characters beyond ASCII. A feature's hash goes
    on from that of its words before the last, so no feature is put together.
    """
    words = _WORD.findall((text or "").encode().lower())
    hashes = last = list(map(crc32, words))
    for k in range(1, order):
        last = [crc32(w, crc32(b" ", h)) for w, h in zip(words[k:], last)]
        hashes = hashes + last
    return len(words), np.array(hashes, np.int64) % n_buckets


def counted(docs: DataFrame, order: int = ORDER, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. Tasks count in an array each; ``n_buckets`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                tally += np.bincount(features(text.as_py(), order, n_buckets)[1], minlength=n_buckets)
        used = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(tally[used])], names=["bucket", "n"])

    total = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(n_buckets, np.int64)
    for r in total.collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of how much more common it is in the target, in thousandths, rounded down."""
    n = len(source)
    all_s, all_t = float(source.sum() + n), float(target.sum() + n)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_s / (float(s + 1) * all_t))) for s, t in pairs], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel number, rounded down, from a hash of seed and document; a null id counts as ``null``."""
    label = f"{seed}:{'null' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(label.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, table: np.ndarray, seed: int, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; a text without features has weight 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for text, doc_id in zip(batch.column("text"), ids, strict=True):
                n_words, own = features(text.as_py(), order, len(table))
                weight = int(table[own].sum()) // len(own) if len(own) else 0
                rows.append((n_words, len(own), weight, weight + gumbel(seed, doc_id)))
            cells = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in cells)], names=["doc_id", "n_words", "n_features", "weight", "score"]
            )

    fields = "doc_id long, n_words long, n_features long, weight long, score long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)


def least_reaching(rows: DataFrame, value: str, wanted: int) -> int | None:
    """The greatest threshold that at least ``wanted`` rows reach, null values left out; None if all are too few.

    The interval that holds it is cut into ``SECTIONS`` by every job, so jobs grow with the logarithm of the values'
    range. Only counts come to the driver.
    """
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if ends["n"] < wanted or ends["n"] == 0:
        return None
    lo, hi = ends["lo"], ends["hi"]  # the threshold is in [lo, hi]
    while lo < hi:
        steps = sorted({lo + ((hi - lo) * k + SECTIONS - 1) // SECTIONS for k in range(1, SECTIONS + 1)} - {lo})
        told = rows.agg(*[F.count_if(F.col(value) >= t).alias(f"n{k}") for k, t in enumerate(steps)]).first()
        reached = [t for k, t in enumerate(steps) if told[f"n{k}"] >= wanted]
        missed = [t for k, t in enumerate(steps) if told[f"n{k}"] < wanted]
        lo = reached[-1] if reached else lo
        hi = missed[0] - 1 if missed else lo
    return lo


def drawn(table: DataFrame, wanted: int) -> DataFrame:
    """``table`` with a rank for the ``wanted`` rows of the highest score, ties to the smaller doc_id, null ids last.

    ``table`` has doc_id, n_features, weight, score and ``eligible``, and should be stored. Rows that share score and doc_id
    rank by weight and n_features. Rows that are not drawn have a null rank.
    """
    open_ = table.filter("eligible")
    cut = least_reaching(open_, "score", wanted) if wanted > 0 else None
    out = table.withColumn("rank", F.lit(None).cast("long"))
    if cut is None:
        if wanted <= 0:
            return out
        raise ValueError("more rows are wanted than are eligible")
    more = wanted - open_.filter(F.col("score") > cut).count()
    tied = open_.filter(F.col("score") == cut).select((-F.col("doc_id")).alias("_turned"))
    least = least_reaching(tied, "_turned", more)
    reaches = (F.col("score") == cut) & (F.lit(True) if least is None else F.coalesce(F.col("doc_id") <= -least, F.lit(False)))
    chosen = F.col("eligible") & ((F.col("score") > cut) | reaches)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranked = rank_in_group(table.filter(chosen), [], order, "rank")
    # Only repeated rows at the cutoff can be too many.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank").cast("long")))
    return out.filter(~chosen).unionByName(ranked)


def resampled(docs: DataFrame, target: DataFrame, seed: int, percent: int, min_words: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and its rank in a draw of ``percent`` of the long enough ones.

    Documents with fewer than ``min_words`` words are scored but never drawn. Null texts have no words; repeated rows stay and
    may be drawn each. Without a target all gains speak for rare features; empty ``docs`` give no rows. Columns besides
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    table = gains(counted(docs), counted(target))
    path = scratch_path(spark, "importance")
    scored(docs, table, seed).withColumn("eligible", F.col("n_words") >= min_words).drop("n_words").write.parquet(path)
    stored = spark.read.parquet(path)
    n = stored.agg(F.count_if("eligible").alias("n")).first()["n"]
    return drawn(stored, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")
