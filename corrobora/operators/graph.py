"""Principal components, exact nearest neighbours and graph communities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.draws import draw_hash
from corrobora.operators.neighbours import Searched
from corrobora.operators.propagation import propagate
from corrobora.session import cut_lineage

MAX_PIVOTS = 1024
ROWS_AT_ONCE = 256
"""Rows whose distances to all pivots, or to a block, are held at once."""

LEAST_BLOCK, MAX_BLOCK = 1 << 12, 1 << 16
ROUNDING = 1e-12
"""Share of the largest square by which a squared distance from products may be wrong."""


def principal_components(df: DataFrame, key: str, features: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores on ``k`` components of the centred features, and the variance ratio of each.

    Component signs are arbitrary. Spark's transform does not subtract the mean, so the
    features are centred first.
    """
    vectors = df.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    mean = vectors.agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mean")).first()["_mean"]
    shift = F.array(*[F.lit(float(m)) for m in mean])
    centred = df.select(
        key,
        array_to_vector(
            F.zip_with(F.col(features).cast("array<double>"), shift, lambda x, m: x - m)
        ).alias("_v"),
    )
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(centred)
    scores = model.transform(centred).select(key, vector_to_array("_pc").alias("components"))
    ratio = df.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())],
        "component int, variance_ratio double",
    )
    return scores, ratio


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by direct differences, so equal vectors give equal values in every block."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt((d * d).sum(axis=2))
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products, for bounds that leave room for their rounding."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)


def _block_rows(rows: int, tasks: int) -> int:
    """Rows of a block: some blocks and chunks for each task at once, and no more rows than a task may hold."""
    return max(LEAST_BLOCK, min(MAX_BLOCK, math.ceil(rows / (2 * math.sqrt(tasks)))))


def _bundled(sizes: dict[int, int], between: np.ndarray, block_rows: int) -> tuple[np.ndarray, list[int]]:
    """The bundle of every cell and the parts of every bundle.

    Cells, each followed by the nearest one left, share a bundle of up to ``block_rows`` rows; a larger cell is a bundle of several parts.
    """
    bundle, rows = np.full(len(between), -1), []
    left, at = sorted(sizes), min(sizes)
    while left:
        at = min(left, key=lambda c: between[at, c])
        left.remove(at)
        if not rows or rows[-1] + sizes[at] > block_rows:
            rows.append(0)
        rows[-1] += sizes[at]
        bundle[at] = len(rows) - 1
    return bundle, [-(-n // block_rows) for n in rows]


def nearest_neighbours(
    df: DataFrame,
    key: str,
    features: str,
    k: int,
    pivots: int | None = None,
    block_rows: int | None = None,
    seed: int = 1,
    queries: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest other rows of every row (or of those whose key is in ``queries``), exactly, as ``(src, dst, distance, rank)``.

    Rows are grouped round pivots, as many as the square root of the rows unless given. A row visits only the pivot cells whose distance
    bounds (triangle inequality and dividing plane) can still hold one of its neighbours; pivots are rows too, so their distances bound those of the neighbours.
    Near cells are bundled to blocks of ``block_rows`` rows (by the number of rows, unless given) and visitors dealt to chunks of half as many, so a row is sent to a block once,
    however many of its cells it visits, and a dense cell is shared out over tasks. A task holds a block and a chunk,
    and some hundreds of visitors are worked off at once; each block returns at most ``k`` rows per visitor. Equal
    distances are ordered by id.
    """
    if pivots is None or block_rows is None:
        rows = df.count()
        pivots = pivots or min(MAX_PIVOTS, 1 + math.isqrt(rows))
        block_rows = block_rows or _block_rows(rows, df.sparkSession.sparkContext.defaultParallelism)
    if not 1 <= pivots <= MAX_PIVOTS:
        raise ValueError(f"pivots must be between 1 and {MAX_PIVOTS}")
    data = df.select(F.col(key).cast("bigint").alias("id"), F.col(features).alias("vec"))
    vec_type = data.schema["vec"].dataType.simpleString()
    chosen = data.orderBy(draw_hash(F.lit(seed), F.col("id")), "id").limit(pivots).collect()
    if not chosen:
        return df.sparkSession.createDataFrame([], "src bigint, dst bigint, distance double, rank int")
    centres = np.array([row["vec"] for row in chosen], dtype=float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                vec = _stack(part["vec"])
                cell = _squares(vec, centres).argmin(axis=1)
                apart = vec - centres[cell]
                yield part.assign(cell=cell.astype("int32"), radius=np.sqrt((apart * apart).sum(axis=1)))

    assigned = cut_lineage(data.mapInPandas(assign, f"id bigint, vec {vec_type}, cell int, radius double"))

    # a few numbers for each pivot come to the driver
    near = Window.partitionBy("cell").orderBy("radius", "id")
    small = assigned.select("cell", "radius", "id").withColumn("_r", F.row_number().over(near)).filter(F.col("_r") == k + 1)
    full = np.full(len(centres), np.inf)
    for row in small.select("cell", "radius").collect():
        full[row["cell"]] = row["radius"]
    sizes = assigned.groupBy("cell").agg(F.max("radius").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    far = np.full(len(centres), -np.inf)
    for row in sizes:
        far[row["cell"]] = row["far"]
    unsure = ROUNDING * (far.max() + np.sqrt((centres * centres).sum(axis=1).max())) ** 2
    between = _distances(centres, centres)
    bundle, parts = _bundled({r["cell"]: r["n"] for r in sizes}, between, block_rows)
    filled = np.flatnonzero(bundle >= 0)
    held = np.zeros((len(filled), len(parts)), np.float32)
    held[np.arange(len(filled)), bundle[filled]] = 1

    def visited(square: np.ndarray, some: np.ndarray, own: np.ndarray, own_d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which of ``some`` cells, at squared distances ``square``, can hold a neighbour of rows of the cells ``own`` within ``bound``."""
        gap = between[own][:, some]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (square - (own_d * own_d)[:, None] - 4 * unsure) / (2 * gap), 0.0)
        low = np.maximum(np.maximum(np.sqrt(np.maximum(square - unsure, 0.0)) - far[some], plane), 0.0)
        return low <= bound[:, None] * (1 + 1e-9) + 1e-9

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                square = _squares(_stack(part["vec"]), centres)
                most = np.sqrt(np.maximum(square, 0.0) + unsure)
                bound = (most + full).min(axis=1)  # one of the k + 1 nearest is the row itself
                if len(centres) > k:
                    bound = np.minimum(bound, np.partition(most, k, axis=1)[:, k])
                visit = visited(square[:, filled], filled, part["cell"].to_numpy(), part["radius"].to_numpy(), bound)
                to = [np.flatnonzero(x).astype("int32") for x in visit.astype(np.float32) @ held]
                yield part.rename(columns={"id": "qid", "vec": "qvec", "cell": "own"}).assign(bound=bound, bundles=to)

    asked = assigned if queries is None else assigned.join(queries.select(F.col(key).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    routed = cut_lineage(asked.select("id", "vec", "cell", "radius").mapInPandas(
        route, f"qid bigint, qvec {vec_type}, own int, radius double, bound double, bundles array<int>"
    )).withColumn("bundle", F.explode("bundles")).drop("bundles")
    chunks = [0] * len(parts)
    for r in routed.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect():
        chunks[r["bundle"]] = -(-r["n"] // -(-block_rows // 2))
    lookup = lambda table, at: F.get(F.array(*[F.lit(int(x)) for x in table]), F.col(at))
    fan = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    keys = ["bundle", "block", "chunk"]
    queries = routed.withColumn("chunk", F.pmod(F.xxhash64("qid"), lookup(chunks, "bundle")).cast("int")).withColumn(
        "block", fan(lookup(parts, "bundle"))
    )
    objects = (
        assigned.withColumn("bundle", lookup(bundle, "cell"))
        .withColumn("block", F.pmod(F.xxhash64("id"), lookup(parts, "bundle")).cast("int"))
        .withColumn("chunk", fan(lookup(chunks, "bundle")))
        .select(*keys, "id", "vec", "cell")
    )

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("cell", kind="stable")
            searched, cell = Searched(right["id"].to_numpy(), _stack(right["vec"])), right["cell"].to_numpy()
            some = np.unique(cell)
            left = left.sort_values("own", kind="stable")
            for at in range(0, len(left), ROWS_AT_ONCE):
                part = left.iloc[at : at + ROWS_AT_ONCE]
                vec, bound = _stack(part["qvec"]), part["bound"].to_numpy()
                visit = visited(_squares(vec, centres[some]), some, part["own"].to_numpy(), part["radius"].to_numpy(), bound)
                inside = np.isin(cell, some[visit.any(axis=0)])
                if inside.any():
                    found += list(searched.nearest(part["qid"].to_numpy(), vec, k, bound, inside))
        src, dst, distance = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        return pd.DataFrame({"src": src, "dst": dst, "distance": distance})

    # as many partitions that few blocks with their chunks share one, which would work them off one after the other
    pieces = 2 * sum(n * c for n, c in zip(parts, chunks)) + 1
    dealt = [x.repartition(pieces, *keys).groupBy(*keys) for x in (queries, objects)]
    partial = dealt[0].cogroup(dealt[1]).applyInPandas(nearest, "src bigint, dst bigint, distance double")
    best = Window.partitionBy("src").orderBy("distance", "dst")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with one whole-number weight per pair (the larger one)."""
    both = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    return both.filter("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def communities_by_resolution(vertices: DataFrame, edges: DataFrame, resolutions: Sequence[float]) -> DataFrame:
    """Weighted label propagation until the labels settle, as ``(resolution, id, community, rounds, settled)``.

    In each round every vertex takes the label with the largest summed weight among its
    neighbours, its own label weighing ``resolution`` times its mean edge weight; the smallest
    label wins ties. Weights are whole numbers, so sums do not depend on order. Rounds end when
    a state of all labels comes up again: the last one's (``settled``), or an earlier one's, between
    which the labels would swing for ever. Each round is written out, which bounds the lineage.
    """
    return propagate(vertices, cut_lineage(undirected(edges)), resolutions)


def communities(vertices: DataFrame, edges: DataFrame, resolution: float) -> DataFrame:
    """:func:`communities_by_resolution` of one resolution, as ``(id, community, rounds, settled)``."""
    return communities_by_resolution(vertices, edges, [resolution]).drop("resolution")


def edge_weights(neighbours: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Whole-number similarity ``scale / (1 + distance)``."""
    return neighbours.select(
        "src", "dst", F.floor(F.lit(float(scale)) / (F.lit(1.0) + F.round("distance", 4))).cast("bigint").alias("weight")
    )
