"""Near copies by the Jaccard similarity of their shingle sets, through a byte-position index with count filtering.

A text's fingerprint has ``POSITIONS`` bytes, one of each MinHash; two texts share a positional byte about as often as
their sets are alike. The index is kept on the ``BANDS`` runs of ``ROWS`` positions: a pair at a similarity of 0.8
meets in one of them with a probability of 1 - (1 - 0.8^7)^40 = 0.9999, closer ones with a greater. A posting is never listed; it joins its
members to its least one, and what is joined makes clusters. In a cluster the shared positional bytes of pairs
are tallied, and pairs that reach ``LEAST_EQUAL`` are verified on the hashes of all their shingles. Two texts are linked
if at least ``LEAST`` of the shingles in either are in both.

A cluster may hold any share of the rows. It is dealt to blocks, and tasks compare two blocks each and return
edges that span what they link, one for each member at most. First all blocks meet the first one; then only
members that are outside the cluster's largest component by then meet all others. Pairs within one component need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm import simhash
from corrobora.llm.components import components
from corrobora.session import cut_lineage, join_statistics, scratch_path

LEAST = (4, 5)
"""Least similarity, as numerator and denominator."""

BANDS, ROWS = 40, 7
POSITIONS = BANDS * ROWS
LEAST_EQUAL = 190
"""Shared positional bytes from which a pair is verified: five standard deviations below the mean at 0.8."""

BLOCK_MEMBERS, BLOCK_BYTES = 256, 1 << 23
SEED = 42
CHUNK = 1 << 10
COLUMNS_AT_ONCE = 1 << 12

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, (POSITIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, (POSITIONS, 1), dtype=np.uint64)

Member = tuple[int, np.ndarray, np.ndarray]
"""Node, fingerprint and sorted shingle hashes."""


def shingles(text: str | None, words: int) -> set[bytes]:
    """Runs of ``words`` words, A-Z lower-cased; of fewer words one run of all; of no word none."""
    own = (text or "").encode().lower().split()
    if not own:
        return set()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles."""
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in shingles(text, words)]), ">u8").astype(np.uint64))


def sketch(own: np.ndarray) -> np.ndarray:
    """The fingerprint: a byte of each MinHash of the set."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        least = np.minimum(least, (_FACTORS * own[at : at + CHUNK] + _TERMS).min(axis=1))
    # The lowest bits of a product know only the lowest bits of its factors: mix before a byte is taken.
    mixed = (least ^ (least >> np.uint64(29))) >> np.uint64(8)
    return (mixed & np.uint64(255)).astype(np.uint8)


def keys(prints: np.ndarray) -> np.ndarray:
    """Index keys of fingerprints, ``BANDS`` for each: the number of a run of positions and its bytes."""
    runs = prints.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), runs.shape[:2]).copy()
    for k in range(ROWS):
        out = out << np.uint64(8) | runs[:, :, k]
    return out.view(np.int64)


def _marked(words: int, by_simhash: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.array([simhash.fingerprint(t.as_py(), words) if by_simhash else 0 for t in texts], np.uint64).view(np.int64)
            found = [hashes(t.as_py(), words) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
            prints = pa.array([sketch(h).tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(nodes), prints, pa.array(fps)], names=["row", "node", "sketch", "fp"])

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(list(keys(prints)), pa.list_(pa.int64()))], names=["node", "keys"]
        )


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([hashes(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "cluster", "sketch")] + [own], names=["node", "cluster", "sketch", "hashes"]
            )

    return run


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of hashes that each of ``a`` shares with each of ``b``, from products of incidence matrices."""
    both = [*a, *b]
    column = np.unique(np.concatenate(both), return_inverse=True)[1]
    row = np.repeat(np.arange(len(both)), list(map(len, both)))
    times = np.bincount(column, minlength=1)
    often = times[column] > 1
    row, column = row[often], (np.cumsum(times > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        part = np.zeros((len(both), COLUMNS_AT_ONCE), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += (part[: len(a)] @ part[len(a) :].T).astype(np.int64)
    return out


def links(left: list[Member], right: list[Member]) -> list[tuple[int, int]]:
    """Edges that span what is linked between two blocks: of each member one at most leads to another component."""
    prints = np.array([m[1] for m in right])
    able = np.array([(prints == m[1]).sum(axis=1) >= LEAST_EQUAL for m in left])
    able &= np.array([m[0] for m in left])[:, None] != np.array([m[0] for m in right])[None, :]
    rows, cols = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
    if not len(rows):
        return []
    a, b = [left[i] for i in rows], [right[j] for j in cols]
    both = shared([m[2] for m in a], [m[2] for m in b])
    sizes = np.array([len(m[2]) for m in a])[:, None] + np.array([len(m[2]) for m in b])[None, :]
    near = (LEAST[1] * both >= LEAST[0] * (sizes - both)) & able[np.ix_(rows, cols)]
    nodes, at = np.unique([m[0] for m in a] + [m[0] for m in b], return_inverse=True)
    label = np.arange(len(nodes))
    edges = []
    for i, linked in enumerate(near):
        mine = at[i]
        others = at[len(a) + np.flatnonzero(linked)]
        roots, first = np.unique(label[others], return_index=True)
        for root, j in zip(roots.tolist(), first.tolist(), strict=True):
            if root != label[mine]:
                edges.append((int(nodes[mine]), int(nodes[others[j]])))
                label[label == root] = label[mine]
    return edges


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each task of the stream; a task's rows follow each other."""

    def edges(sides: tuple[list[Member], list[Member]]) -> list[tuple[int, int]]:
        left, right = sides
        return links(left, right or left) if left else []

    now, sides = None, ([], [])
    found: list[tuple[int, int]] = []
    for batch in batches:
        columns = (batch.column(c) for c in ("cluster", "first", "second", "side", "node", "sketch", "hashes"))
        for *task, side, node, print_, own in zip(*columns, strict=True):
            task = [t.as_py() for t in task]
            if task != now:
                found += edges(sides)
                now, sides = task, ([], [])
            sides[side.as_py()].append((node.as_py(), np.frombuffer(print_.as_py(), np.uint8), np.frombuffer(own.as_py(), np.uint64)))
        yield _edge_batch(found)
        found = []
    yield _edge_batch(edges(sides))


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(ends, names=["u", "v"])


def _run(tasks: DataFrame) -> DataFrame:
    keys_ = ["cluster", "first", "second"]
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tasks.repartition(n, *keys_).sortWithinPartitions(*keys_, "side")
    return cut_lineage(ordered.select(*keys_, "side", "node", "sketch", "hashes").mapInArrow(_compared, "u long, v long"))


def _in_blocks(df: DataFrame, size: str, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("node"), F.col(size)).cast("int"))


def _upto(n: str):
    return F.sequence(F.lit(0), F.col(n).cast("int") - 1)


def clusters(classes: DataFrame) -> DataFrame:
    """(node, cluster) of what meets others in the index of ``classes`` (node, sketch)."""
    postings = classes.mapInArrow(_indexed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    shared_ = postings.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last")).filter("least < last")
    met = join_statistics(postings, shared_.select("key", "least"), ["key"]).filter("node <> least")
    return components(met.select(F.col("node").alias("u"), F.col("least").alias("v"))).withColumnRenamed("component", "cluster")


def linked(marked: DataFrame, words: int) -> DataFrame:
    """(node, component) of the texts that are linked to another. ``marked`` has row (with text), node and sketch."""
    found = cut_lineage(clusters(marked.groupBy("node").agg(F.first("sketch").alias("sketch"))))
    own = marked.select("node", F.col("row.text").alias("text"), "sketch").join(found, "node", "left_semi")
    texts = own.groupBy("node").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")).join(found, "node")
    path = scratch_path(marked.sparkSession, "near-sets")
    texts.select("node", "cluster", "sketch", "text").mapInArrow(_sets(words), "node long, cluster long, sketch binary, hashes binary").write.parquet(path)
    sets = marked.sparkSession.read.parquet(path)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES), F.lit(1))
    sizes = cut_lineage(sets.groupBy("cluster").agg(blocks.cast("long").alias("blocks")))
    dealt = _in_blocks(join_statistics(sets, sizes, ["cluster"]), "blocks", "block")

    # All blocks meet the first one.
    meets = F.when(F.col("block") == 0, _upto("blocks")).otherwise(F.array("block"))
    tasks = dealt.withColumn("second", F.explode(meets)).withColumn("first", F.lit(0))
    edges = _run(tasks.withColumn("side", F.when(F.col("block") == 0, 0).otherwise(1)))
    big = sizes.filter("blocks > 1")
    if big.isEmpty():
        return components(edges)

    # Members outside the largest component of a cluster that has more blocks meet all.
    groups = cut_lineage(components(edges))
    rooted = dealt.filter("blocks > 1").select("node", "cluster", "blocks", "block").join(groups, "node", "left")
    rooted = cut_lineage(rooted.withColumn("root", F.coalesce("component", "node")).drop("component"))
    most = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    rest = join_statistics(rooted, most, ["cluster"]).filter("root <> main AND block > 0").select("node", "cluster", "blocks")
    n_rest = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    parts = F.least("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("blocks") * 1.0 / F.col("n_all")))).cast("long")
    n_all = rooted.groupBy("cluster", "blocks").agg(F.count(F.lit(1)).alias("n_all"))
    parts_of = cut_lineage(n_rest.join(n_all, "cluster").select("cluster", parts.alias("parts")))
    chosen = _in_blocks(join_statistics(rest, parts_of, ["cluster"]), "parts", "first").select("node", "first")
    against = join_statistics(dealt.filter("blocks > 1"), parts_of, ["cluster"])
    columns = ["cluster", "node", "sketch", "hashes", "first", "second", "side"]
    left = against.join(chosen, "node").withColumn("second", F.explode(_upto("blocks"))).withColumn("side", F.lit(0))
    right = against.withColumn("first", F.explode(_upto("parts"))).withColumn("second", F.col("block")).withColumn("side", F.lit(1))
    more = _run(left.select(*columns).unionByName(right.select(*columns)))
    return components(edges.unionByName(more))


def simhash_edges(marked: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the nodes whose SimHash fingerprints ``fp`` are equal or differ in two bits at most."""
    pairs = cut_lineage(marked.select("node", "fp").distinct())
    least = cut_lineage(pairs.groupBy("fp").agg(F.min("node").alias("least")))
    equal = join_statistics(pairs, least, ["fp"]).filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    named = lambda fp, end: least.select(F.col("fp").alias(fp), F.col("least").alias(end))
    found = simhash.links(least.select("fp")).withColumnsRenamed({"u": "fp_u", "v": "fp_v"})
    return equal.unionByName(found.join(named("fp_u", "u"), "fp_u").join(named("fp_v", "v"), "fp_v").select("u", "v"))


def representatives(docs: DataFrame, words: int = 5, by_simhash: bool = False) -> DataFrame:
    """``docs`` without near copies: of each component the row of the least (doc_id, set of shingles) stays, null ids last.

    Equal rows of one doc_id are one document and stay or go together; of rows without an id one stays. Null texts and texts
    without words have the same, empty set and are copies of each other. Texts are read whole, whatever their length; a text with
    fewer words than a shingle has one shingle. An empty table stays empty. Other columns may have any name and are kept.
    With ``by_simhash`` texts whose SimHash fingerprints link (:mod:`corrobora.llm.simhash`) are near copies too.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "near-copies")
    rows = docs.select(F.struct("*").alias("row"), "text")
    rows.mapInArrow(_marked(words, by_simhash), f"row {rows.schema['row'].dataType.simpleString()}, node long, sketch binary, fp long").write.parquet(path)
    marked = spark.read.parquet(path)
    groups = linked(marked, words)
    if by_simhash:
        groups = components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(simhash_edges(marked)))
    ids = marked.groupBy("node").agg(F.min("row.doc_id").alias("least"))
    ids = ids.join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("m")
    kept = cut_lineage(ids.groupBy("root").agg(first).select(F.col("m.node").alias("_n"), F.col("m.least").alias("_d")))
    same = (marked["node"] == kept["_n"]) & marked["row.doc_id"].eqNullSafe(kept["_d"])
    stay = marked.join(kept, same, "left_semi")
    alone = stay.filter("row.doc_id IS NULL").dropDuplicates(["node"])
    return stay.filter("row.doc_id IS NOT NULL").unionByName(alone).select("row.*")
