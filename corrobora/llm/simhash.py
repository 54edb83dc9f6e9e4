"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints with at most two different bits share at least six of their eight positional bytes.
A tally per pair over the postings of single bytes would list every pair that shares a byte. The index
here is kept on the sets of six positions instead: a pair's tally reaches the minimum of six exactly if it
meets in a posting. A posting then fixes 48 bits, so it has at most 65,536 different fingerprints,
whatever the table's size; verification inside it goes by bits and returns one edge for each member at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.components import components
from corrobora.session import cut_lineage

BYTES = 8
MAX_BITS = 2
SEED = 42
SPACE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 14
FULL = (1 << 64) - 1

# Differences of one or two bits within two bytes.
_MASKS = np.array(
    [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], dtype=np.int64
)


def fingerprint(text: str | None, words: int) -> int:
    """Bit i is set if it is set in over half of the XXH64 (seed 42) of the text's shingles, repeats included."""
    plain = b" ".join((text or "").encode().lower().split())
    if not plain:
        return 0
    ends = [i for i, c in enumerate(plain) if c == 32] if len(plain) < 64 else np.flatnonzero(np.frombuffer(plain, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(plain))
    n = max(1, len(starts) - words + 1)
    lasts = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        joined = b"".join([digest(plain[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], lasts[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of whole texts, A-Z lower-cased; fp is the fingerprint as a signed long.

    Words are maximal runs without ``[\\x20\\x09-\\x0D]``. A text with fewer words than a shingle has one
    shingle of all of them; a text without words has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _spanning(members: np.ndarray, free: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked within a posting. ``free``: the two byte positions that may differ."""
    u = members.view(np.uint64)
    low = np.zeros(len(u), np.int64)
    for k, b in enumerate(free):
        low |= ((u >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64) << (8 * k)
    where = np.full(1 << 16, -1, np.int64)
    where[low] = np.arange(len(u))
    masks = _MASKS[:16] if max_bits == 1 else _MASKS
    label = np.arange(len(u))
    while True:
        new = label.copy()
        for m in masks:
            other = where[low ^ m]
            near = other >= 0
            new[near] = np.minimum(new[near], label[other[near]])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(u)))
    return list(zip(members[moved].tolist(), members[label[moved]].tolist(), strict=True))


def _near(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The same edges for a small posting, by comparing all its members."""
    u = members.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= max_bits
    label = np.arange(len(u))
    while True:
        new = np.where(near, label[None, :], len(u)).min(axis=1)
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(u)))
    return list(zip(members[moved].tolist(), members[label[moved]].tolist(), strict=True))


def _verified(max_bits: int, subsets: list[tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for subset, members in zip(batch.column("subset").to_pylist(), batch.column("members"), strict=True):
                fps = np.asarray(members.values.to_numpy(zero_copy_only=False))
                if len(fps) == 2:
                    a, b = fps.tolist()
                    edges += [(a, b)] if ((a ^ b) & FULL).bit_count() <= max_bits else []
                elif len(fps) <= 256:
                    edges += _near(fps, max_bits)
                else:
                    free = [b for b in range(BYTES) if b not in subsets[subset]]
                    edges += _spanning(fps, free, max_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())],
                names=["u", "v"],
            )

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) between different fingerprints ``fp`` that connect all those within ``max_bits`` bits (2 at most)."""
    if not 1 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits can be 1 to {MAX_BITS}")
    shared = BYTES - MAX_BITS
    subsets = list(combinations(range(BYTES), shared))

    def kept(subset: tuple[int, ...]) -> Column:
        value = sum(255 << (8 * b) for b in subset)
        return F.col("fp").bitwiseAND(F.lit(value - (1 << 64) if value >> 63 else value).cast("long"))

    # The fingerprints are few bytes but become many postings: deal them out before that.
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = (
        classes.select("fp").repartition(tasks).select("fp", F.posexplode(F.array(*(kept(s) for s in subsets))).alias("subset", "bytes"))
        .groupBy("subset", "bytes")
        .agg(F.collect_list("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select("subset", "members")
    )
    return postings.mapInArrow(_verified(max_bits, subsets), "u long, v long").distinct()


def grouped(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, and component_id, the least doc_id reachable over links.

    Rows with equal fingerprints are linked; different fingerprints link at ``max_bits`` or fewer different
    bits. A null doc_id takes part, and is named only if its whole component has no other id.
    """
    prints = cut_lineage(fingerprints(docs, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(classes.select("fp"), max_bits))
    merged = classes.join(groups, classes["fp"] == groups["node"], "left").select(
        classes["fp"], "least", F.coalesce("component", classes["fp"]).alias("root")
    )
    merged = cut_lineage(merged)
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = merged.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row of the least doc_id stays.

    Rows that share a doc_id are one document and stay or go together.
    """
    gone = grouped(docs, words, max_bits).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
