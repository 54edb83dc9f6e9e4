"""Exact top-k search by inner product with dual trees.

The upper levels are shared: pivots, chosen far apart from a bounded sample, form cells, and cells fall
into blocks of bounded size. In each block data and queries get a cover tree of their own. A pair of nodes
is left out if no inner product between them can reach the worst k-th score of the queries in it: with
centres c, d and covering radii r, s it is at most c.d + r|d| + s|c| + rs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.session import cut_lineage

SAMPLE = 4096
"""Vectors among which the pivots are chosen; every vector is indexed."""

MOST_PIVOTS = 1024
CELL_ROWS = 2048
QUERY_ROWS = 512
LEAF = 256
SLACK = 1e-6


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of vectors without null or non-finite components.

    Rows without vec_id take no part; of rows that share one, the least vector counts.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~bad)
    v = F.transform(x, lambda c: F.floor(c * scale).cast("int"))
    return whole.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64)
    return values.reshape(len(column), -1)


def _far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """The first point and then always the one farthest from all before, n at most, no two equal."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, float, int, int, list[int]]]]:
    """An order of the points, and nodes (centre, radius, begin, end, children) over it; node 0 is the root.

    A node's children have centres that lie far apart, chosen until they cover it at half its radius or there
    would be fewer than ``LEAF`` points for each: in many dimensions half the radius can ask for nearly as
    many centres as points, and a pair of such nodes costs more than it saves. Radii are the true ones.
    """
    order = np.arange(len(points))
    nodes: list[tuple[np.ndarray, float, int, int, list[int]]] = []

    def grow(begin: int, end: int, centre: np.ndarray, away: np.ndarray) -> int:
        radius = float(np.sqrt(away.max()))
        here = len(nodes)
        children: list[int] = []
        nodes.append((centre, radius, begin, end, children))
        if end - begin <= LEAF or radius == 0:
            return here
        own = points[order[begin:end]]
        nearest, least = np.zeros(len(own), np.int64), away.copy()
        centres = [centre]
        while least.max() > radius * radius / 4 and len(centres) < max(2, (end - begin) // LEAF):
            far = own[int(least.argmax())]
            d = ((own - far) ** 2).sum(axis=1)
            nearest[d < least] = len(centres)
            least = np.minimum(least, d)
            centres.append(far)
        sort = np.argsort(nearest, kind="stable")
        order[begin:end] = order[begin:end][sort]
        nearest, least = nearest[sort], least[sort]
        cuts = np.searchsorted(nearest, np.arange(len(centres) + 1))
        if np.diff(cuts).max() > 0.9 * (end - begin):  # a few outliers are not worth a level
            return here
        for c, (a, b) in zip(centres, zip(cuts[:-1], cuts[1:]), strict=True):
            if b > a:
                children.append(grow(begin + int(a), begin + int(b), c, least[a:b]))
        return here

    start = points[0]
    grow(0, len(points), start, ((points - start) ** 2).sum(axis=1))
    return order, nodes


BLOCK = "cell int, block int, n int, radius double, centre array<double>, around double, tree binary"


def _built(pivots: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        points = _matrix(table.column("v"))
        order, nodes = cover_tree(points)
        centre = points.mean(axis=0)
        tree = pickle.dumps(
            (np.asarray(table.column("vec_id"))[order], points[order].astype(np.float64), nodes), protocol=5
        )
        return pa.Table.from_pylist(
            [
                {
                    "cell": cell,
                    "block": key[1].as_py(),
                    "n": len(points),
                    "radius": float(np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1).max())),
                    "centre": centre.tolist(),
                    "around": float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())),
                    "tree": tree,
                }
            ],
            schema=pa.schema(
                [("cell", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("radius", pa.float64()),
                 ("centre", pa.list_(pa.float64())), ("around", pa.float64()), ("tree", pa.binary())]
            ),
        )

    return run


def _assigned(pivots: np.ndarray):
    norms = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("v"))
                cell = (norms[None, :] - 2 * points @ pivots.T).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"]
                )

    return run


def _blocks(assigned: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """One row for each block of a cell, with its tree; a cell has as many blocks as its rows need."""
    sizes = assigned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    parts = F.create_map(*(F.lit(x) for r in sizes.collect() for x in (r["cell"], r["parts"])))  # one for each pivot
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(parts, F.col("cell"))).cast("int")
    dealt = assigned.withColumn("block", block).repartition("cell", "block")
    return cut_lineage(dealt.groupBy("cell", "block").applyInArrow(_built(pivots), BLOCK))


class _Best:
    """The best scores of a block's queries so far; ties go to smaller ids."""

    def __init__(self, n: int, k: int, worst: np.ndarray) -> None:
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = worst

    def worst(self, begin: int, end: int) -> float:
        return float(np.maximum(self.scores[begin:end, -1], self.floor[begin:end]).min())

    def offer(self, begin: int, end: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at_least = np.maximum(self.scores[begin:end, -1], self.floor[begin:end])
        good = (scores >= at_least[:, None]) & (scores > -np.inf)
        rows, cols = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
        if not len(rows):
            return
        fresh, ids = scores[np.ix_(rows, cols)], ids[cols]
        all_scores = np.concatenate([self.scores[begin:end][rows], fresh], axis=1)
        all_ids = np.concatenate([self.ids[begin:end][rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[begin + rows] = np.take_along_axis(all_scores, best, axis=1)
        self.ids[begin + rows] = np.take_along_axis(all_ids, best, axis=1)


def _dual(best: _Best, queries: tuple, data: tuple) -> None:
    """Visits pairs of nodes, those with the highest possible score first."""
    q_ids, q, q_nodes = queries
    d_ids, d, d_nodes = data
    q_norm = [float(np.sqrt(n[0] @ n[0])) for n in q_nodes]
    d_norm = [float(np.sqrt(n[0] @ n[0])) for n in d_nodes]

    def bound(a: int, b: int) -> float:
        (c, r, *_), (e, s, *_) = q_nodes[a], d_nodes[b]
        most = float(c @ e) + r * d_norm[b] + s * q_norm[a] + r * s
        return most + SLACK * (1 + abs(most))

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        most, a, b = stack.pop()
        begin, end, below_a = q_nodes[a][2:]
        first, last, below_b = d_nodes[b][2:]
        if most < best.worst(begin, end):
            continue
        if not below_a and not below_b:
            scores = q[begin:end] @ d[first:last].T
            scores[q_ids[begin:end, None] == d_ids[None, first:last]] = -np.inf
            best.offer(begin, end, scores, d_ids[first:last])
            continue
        if below_b and (not below_a or d_nodes[b][1] >= q_nodes[a][1]):
            pairs = [(a, x) for x in below_b]
        else:
            pairs = [(x, b) for x in below_a]
        stack += sorted((bound(x, y), x, y) for x, y in pairs)


def _seeded(k: int):
    """The k-th best scores of a block's queries among some data: no final k-th score is lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, block, tree, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "tree", "data")), strict=True):
                queries = pickle.loads(tree)
                best = _Best(len(queries[0]), k, np.full(len(queries[0]), -np.inf))
                _dual(best, queries, pickle.loads(data))
                out.append({"cell": cell, "block": block, "floors": best.scores[:, -1].tolist(), "worst": float(best.scores[:, -1].min())})
            yield pa.RecordBatch.from_pylist(
                out, schema=pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("floors", pa.list_(pa.float64())), ("worst", pa.float64())])
            )

    return run


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, floors, data in zip(*(batch.column(c) for c in ("tree", "floors", "data")), strict=True):
                queries = pickle.loads(tree.as_buffer())
                floor = floors.as_py()
                floor = np.full(len(queries[0]), -np.inf) if floor is None else np.asarray(floor)
                best = _Best(len(queries[0]), k, floor)
                _dual(best, queries, pickle.loads(data.as_buffer()))
                row, col = np.nonzero((best.scores > -np.inf) & (best.scores >= floor[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[0][row]), pa.array(best.ids[row, col]), pa.array(best.scores[row, col].astype(np.int64))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def _reachable(q: dict[int, tuple[float, float]], d: dict[int, float], pivots: np.ndarray):
    """Pairs of cells whose bound reaches the worst k-th score of the query cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.sqrt((pivots**2).sum(axis=1))
        cells = np.array(sorted(d), np.int64)
        s = np.array([d[c] for c in cells])
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for a in batch.column("cell").to_pylist():
                r, worst = q[a]
                most = pivots[cells] @ pivots[a] + r * norm[cells] + s * norm[a] + r * s
                found = cells[most + SLACK * (1 + np.abs(most)) >= worst]
                left += [a] * len(found)
                right += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["cell", "d_cell"])

    return run


def _same_length(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    n = vectors.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    pivots = _far_apart(np.array([r["v"] for r in sample], np.float64), min(MOST_PIVOTS, 1 + n // CELL_ROWS))
    fields = "vec_id long, v array<int>, cell int"
    data = _blocks(cut_lineage(vectors.mapInArrow(_assigned(pivots), fields)), pivots, CELL_ROWS)
    asked = _blocks(cut_lineage(queries.mapInArrow(_assigned(pivots), fields)), pivots, QUERY_ROWS)

    sizes = {r["cell"]: (r["n"], r["r"]) for r in data.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("r")).collect()}
    q_cells = {r["cell"]: r["r"] for r in asked.groupBy("cell").agg(F.max("radius").alias("r")).collect()}
    full = [c for c in sorted(sizes) if sizes[c][0] > k] or sorted(sizes)
    near = [(c, full[int((pivots[full] @ pivots[c]).argmax())]) for c in sorted(q_cells)]
    first = F.element_at(F.create_map(*(F.lit(x) for p in near for x in p)), F.col("cell"))
    some = data.filter("block = 0").select(F.col("cell").alias("d_cell"), F.col("tree").alias("data"))
    seeds = cut_lineage(
        asked.withColumn("d_cell", first).join(some, "d_cell").select("cell", "block", "tree", "data")
        .mapInArrow(_seeded(k), "cell int, block int, floors array<double>, worst double")
    )
    worst = {r["cell"]: r["w"] for r in seeds.groupBy("cell").agg(F.min("worst").alias("w"), F.count(F.lit(1)).alias("b")).collect()}
    bounds = {c: (r, worst.get(c, float("-inf"))) for c, r in q_cells.items()}
    cells = asked.select("cell").distinct()
    pairs = cells.mapInArrow(_reachable(bounds, {c: r for c, (_, r) in sizes.items()}, pivots), "cell int, d_cell int")

    ready = asked.join(seeds, ["cell", "block"], "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    named = data.select(
        F.col("cell").alias("d_cell"), F.col("centre").alias("d_centre"), F.col("around").alias("d_around"), F.col("tree").alias("data")
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    most = (
        dot("centre", "d_centre")
        + F.col("around") * F.sqrt(dot("d_centre", "d_centre"))
        + F.col("d_around") * F.sqrt(dot("centre", "centre"))
        + F.col("around") * F.col("d_around")
    )
    met = pairs.join(ready, "cell").join(named, "d_cell").filter(most + SLACK * (1 + F.abs(most)) >= F.col("worst"))
    spread = met.select("tree", "floors", "data").repartition(tasks)
    return spread.mapInArrow(_searched(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query among all ``vectors`` but its own.

    Both tables are (vec_id, v) of integers, as ``quantised`` gives them. Ties go to the smaller vec_id;
    vectors of another length than the query's are no candidates. Queries without candidates have no row.
    """
    held, asked = cut_lineage(vectors), cut_lineage(queries)
    lengths = sorted(r[0] for r in asked.select(F.size("v")).distinct().collect())
    found = None
    for n in lengths:
        part = _same_length(held.filter(F.size("v") == n), asked.filter(F.size("v") == n), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")
        ).limit(0)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
