"""Weighted label propagation over blocks of vertices, for several resolutions side by side.

A vertex belongs to one block, by a hash of its id, which holds the edges that reach it. In a round every block gets the labels of
its vertices' neighbours, one message from each block that has some, and sends on the new labels of its own. What a message
holds is fixed by the edges, as each has both directions: the vertices of a block that have a neighbour in the other, in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.stability import mixed
from corrobora.session import cut_lineage

EDGES_AT_LEAST, EDGES_AT_ONCE = 1 << 13, 1 << 20
"""Directed edges of a block, about: where tasks are idle, and at most."""

STATE = "source int, block int, labels binary, digests array<long>"
_U = np.uint64


@dataclass(frozen=True)
class Block:
    """Vertices in ascending order, and their edges in that order."""

    ids: np.ndarray
    starts: np.ndarray  # of the edges of every vertex, and their end
    heard: np.ndarray  # place of an edge's neighbour among the labels of all messages, those of lower blocks first
    weights: np.ndarray
    told: dict[int, np.ndarray]  # by block, the vertices whose labels it gets

    @classmethod
    def of(cls, own: int, ids: np.ndarray, block: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> Block:
        ids = np.unique(np.concatenate([ids, dst]))
        order = np.lexsort((src, dst))
        block, src, weight = block[order], src[order], weight[order]
        place = np.searchsorted(ids, dst[order])
        told = {int(b): np.unique(place[block == b]) for b in np.unique(block).tolist() if b != own}
        heard, at = np.empty(len(src), np.int64), 0
        for b in sorted({own, *told}):
            inside = block == b
            known = ids if b == own else np.unique(src[inside])
            heard[inside] = at + np.searchsorted(known, src[inside])
            at += len(known)
        told[own] = np.arange(len(ids))
        slim = lambda x: x.astype(np.int32) if not len(x) or x.max() < 2**31 else x
        return cls(ids, slim(np.searchsorted(place, np.arange(len(ids) + 1))), slim(heard), slim(weight), {b: slim(x) for b, x in told.items()})

    def own_weights(self, resolution: float) -> np.ndarray:
        """What a vertex's label weighs for itself: a share of its mean edge weight, one without edges."""
        sums = np.concatenate([[0], np.cumsum(self.weights, dtype=np.int64)])
        n = np.diff(self.starts)
        mean = (sums[self.starts[1:]] - sums[self.starts[:-1]]) / np.maximum(n, 1)
        return np.where(n > 0, np.floor(mean * resolution), 1).astype(np.int64)

    def next(self, own: np.ndarray, heard: np.ndarray, resolution: float) -> np.ndarray:
        """The label with the largest summed weight of every vertex, the smallest of them on a tie."""
        n = np.arange(len(self.ids))
        vertex = np.concatenate([np.repeat(n, np.diff(self.starts)), n])
        label = np.concatenate([heard[self.heard], own])
        weight = np.concatenate([self.weights.astype(np.int64), self.own_weights(resolution)])
        different, label = np.unique(label, return_inverse=True)
        order = np.argsort(vertex * len(different) + label, kind="stable")
        vertex, label, weight = vertex[order], label[order], weight[order]
        first = np.flatnonzero((np.diff(vertex, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        vertex, label, votes = vertex[first], label[first], np.add.reduceat(weight, first)
        start = np.flatnonzero(np.diff(vertex, prepend=-1))
        won = np.flatnonzero(votes == np.repeat(np.maximum.reduceat(votes, start), np.diff([*start, len(votes)])))
        return different[label[won[np.flatnonzero(np.diff(vertex[won], prepend=-1))]]]

    def messages(self, own: int, labels: np.ndarray) -> pa.Table:
        """Labels (resolutions x vertices) for every block; the message to itself carries digests of the labels."""
        to = list(self.told)
        digests = [x for r, row in enumerate(labels) for h in (_hashed(self.ids, row), _hashed(row, self.ids)) for x in (h.sum(), np.bitwise_xor.reduce(h))]
        digests = np.array(digests, _U).view(np.int64).tolist()
        return pa.table(
            [pa.array([own] * len(to), pa.int32()), pa.array(to, pa.int32()),
             pa.array([labels[:, self.told[b]].tobytes() for b in to], pa.binary()),
             pa.array([digests if b == own else None for b in to], pa.list_(pa.int64()))],
            names=["source", "block", "labels", "digests"],
        )


def _hashed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(mixed(x.astype(np.int64).view(_U)) + y.astype(np.int64).view(_U))


def propagate(vertices: DataFrame, pairs: DataFrame, resolutions: Sequence[float]) -> DataFrame:
    """Labels of every vertex by resolution, as ``(resolution, id, community, rounds, settled)``.

    ``pairs`` has both directions of every edge once, with whole-number weights. A resolution's labels stay as they are from the round
    on in which their state comes up again; how many rounds that takes is told by digests, four numbers a block and resolution
    of which sums come to the driver.
    """
    spark, many = vertices.sparkSession, len(resolutions)
    n = pairs.count()
    blocks = max(1, -(-n // EDGES_AT_ONCE), min(spark.sparkContext.defaultParallelism, -(-n // EDGES_AT_LEAST)))
    tasks = 2 * blocks
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    edges = pairs.select(place(F.col("dst")).alias("block"), place(F.col("src")).alias("other"), *[F.col(c).cast("long") for c in ("src", "dst", "weight")])
    nodes = vertices.select(F.col("id").cast("long").alias("id")).withColumn("block", place(F.col("id")))
    dealt = lambda df: df.repartition(tasks, "block").groupBy("block")

    def built(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, columns = right.column("id").to_numpy(), [left.column(c).to_numpy() for c in ("other", "src", "dst", "weight")]
        own = key[0].as_py()
        return pa.table([pa.array([own], pa.int32()), pa.array([pickle.dumps(Block.of(own, ids, *columns))], pa.binary())], names=["block", "graph"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, graph in zip(batch.column("block").to_pylist(), batch.column("graph"), strict=True):
                graph = pickle.loads(graph.as_py())
                yield from graph.messages(own, np.tile(graph.ids, (many, 1))).to_batches()

    def read(messages: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        messages = messages.sort_by("source")
        return messages.column("source").to_pylist(), [np.frombuffer(x.as_py(), np.int64).reshape(many, -1) for x in messages.column("labels")]

    def step(live: Sequence[int]):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            own, graph = key[0].as_py(), pickle.loads(right.column("graph")[0].as_py())
            sources, labels = read(left)
            old, heard = labels[sources.index(own)], np.concatenate(labels, axis=1)
            return graph.messages(own, np.stack([graph.next(old[r], heard[r], resolutions[r]) if r in live else old[r] for r in range(many)]))

        return run

    def told(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = pickle.loads(right.column("graph")[0].as_py()).ids
        labels = read(left)[1][0]
        return pa.table([np.repeat(np.arange(many, dtype=np.int32), len(ids)), np.tile(ids, many), labels.ravel()], names=["r", "id", "community"])

    graphs = cut_lineage(dealt(edges).cogroup(dealt(nodes)).applyInArrow(built, "block int, graph binary").repartition(tasks, "block"))
    state = cut_lineage(graphs.mapInArrow(begun, STATE))
    itself = F.col("source") == F.col("block")
    sums = [f(F.get("digests", F.lit(2 * i + j))) for i in range(2 * many) for j, f in enumerate((lambda c: F.sum(c.cast("decimal(38,0)")), F.bit_xor))]
    seen: list[list[tuple]] = [[] for _ in resolutions]
    settled: dict[int, bool] = {}
    while True:
        digest = list(state.filter(itself).agg(*sums).first())
        for r in [r for r in range(many) if r not in settled]:
            now = tuple(digest[4 * r : 4 * r + 4])
            if now in seen[r]:
                settled[r] = seen[r][-1] == now
            else:
                seen[r].append(now)
        live = [r for r in range(many) if r not in settled]
        if not live:
            break
        state = cut_lineage(dealt(state).cogroup(graphs.groupBy("block")).applyInArrow(step(live), STATE))
    labels = dealt(state.filter(itself)).cogroup(graphs.groupBy("block")).applyInArrow(told, "r int, id long, community long")
    by_number = lambda values: F.get(F.array(*map(F.lit, values)), F.col("r"))
    return labels.select(
        by_number([float(x) for x in resolutions]).alias("resolution"), "id", "community",
        by_number([len(x) for x in seen]).alias("rounds"), by_number([settled[r] for r in range(many)]).alias("settled"),
    )
