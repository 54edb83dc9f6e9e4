"""Principal components of sparse counts: block subspace iteration with implicit centring.

A cell is one row of feature numbers and values, never a dense vector. One pass multiplies all cells with a block of
directions and the result back with the cells; the means are taken off by arithmetic on the small products,
so the zeros stay zeros. A pass needs no shuffle of cells: tasks add up their (features x block) product, which is summed and
comes to the driver, where it is made orthogonal. It is bounded by the number of selected features times
the block, both parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.session import cut_lineage

OVERSAMPLING = 10
"""Directions carried beside those asked for, which speeds up convergence."""

FULL_WIDTH = 512
"""Features up to which the block is as wide as they are many, so that one pass is enough."""

MAX_PASSES = 200
SETTLED = 1e-10
"""Largest relative change of a variance from which the iteration ends."""

ROWS_AT_ONCE = 4096


def sparse_rows(values: DataFrame, cells: DataFrame, features: DataFrame, cell: str, feature: str, value: str) -> tuple[DataFrame, list]:
    """(cell, at, x): per cell the numbers of its features and their values, in order; and the features in the order of their numbers.

    ``cells`` and ``features`` say which count; a cell without any of them has an empty row. Features come to the
    driver: their number is a parameter of the selection. Each (cell, feature) stands once.
    """
    names = sorted(r[0] for r in features.select(feature).distinct().collect())
    kind = features.schema[feature].dataType.simpleString()
    numbered = features.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"`{feature}` {kind}, at int")
    known = values.join(F.broadcast(numbered), feature)
    pairs = known.select(cell, F.struct("at", F.col(value).cast("double").alias("x")).alias("p")).filter("p.x <> 0")
    rows = pairs.groupBy(cell).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    wide = cells.select(cell).join(rows, cell, "left")
    at = F.coalesce(F.col("ps.at"), F.array().cast("array<int>"))
    return cut_lineage(wide.select(cell, at.alias("at"), F.coalesce(F.col("ps.x"), F.array().cast("array<double>")).alias("x"))), names


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every entry of a batch."""
    lists = batch.column("at")
    sizes = np.diff(lists.offsets.to_numpy())
    first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
    x = batch.column("x")
    values = x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()]
    return np.repeat(np.arange(len(sizes)), sizes), lists.values.to_numpy()[first:last], values


def _projected(n: int, row: np.ndarray, at: np.ndarray, x: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a block."""
    out = np.zeros((n, block.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(x[:, None] * block[at], starts, axis=0)
    return out


def _moments(rows: DataFrame, n_features: int, block: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Number of cells, sums of the features, X'X times the block, and the sum of squares, from one pass."""
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, total = 0, 0.0, np.zeros((n_features, width + 1))
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(start, ROWS_AT_ONCE)]) for c in whole.columns], names=whole.schema.names)
                row, at, x = _flat(batch)
                n += batch.num_rows
                squares += float(x @ x)
                product = _projected(batch.num_rows, row, at, x, block)
                order = np.argsort(at, kind="stable")
                if len(order):
                    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    own = np.concatenate([x[:, None] * product[row], x[:, None]], axis=1)[order]
                    total[at[order][starts]] += np.add.reduceat(own, starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([squares]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "squares", "total"])

    parts = rows.select("at", "x").mapInArrow(run, "n long, squares double, total array<double>")
    sums = parts.select("n", "squares", F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("squares").alias("q"))
    found = sums.toPandas().sort_values("i")
    if not len(found):
        return 0, np.zeros(n_features), np.zeros((n_features, width)), 0.0
    matrix = found["v"].to_numpy().reshape(n_features, width + 1)
    return int(found["n"].iloc[0]), matrix[:, -1], matrix[:, :-1], float(found["q"].iloc[0])


def components(rows: DataFrame, n_features: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Directions (features x k), shares of the variance, means of the features, and passes made.

    ``rows`` comes from :func:`sparse_rows`. The largest entry of a direction is positive. With as many directions as
    features, or a spectrum without ties, they do not depend on the seed beyond rounding.
    """
    width = n_features if n_features <= FULL_WIDTH else min(n_features, k + OVERSAMPLING)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, width)))[0]
    last = np.zeros(width)
    for passes in range(1, MAX_PASSES + 1):
        n, sums, product, squares = _moments(rows, n_features, block)
        if n == 0:
            return np.zeros((n_features, 0)), np.zeros(0), np.zeros(n_features), passes
        mean = sums / n
        centred = product - n * np.outer(mean, mean @ block)
        small = block.T @ centred
        variance, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(variance)[::-1]
        variance = variance[order]
        found = block @ turn[:, order]
        if np.abs(variance[:k] - last[:k]).max() <= SETTLED * max(variance[0], 1e-300) or width == n_features:
            break
        last, block = variance, np.linalg.qr(centred)[0]
    whole = squares - n * float(mean @ mean)
    directions = found[:, :k]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    shares = np.maximum(variance[:k], 0) / whole if whole > 0 else np.zeros(k)
    return directions, shares, mean, passes


def scores(rows: DataFrame, cell: str, directions: np.ndarray, mean: np.ndarray) -> DataFrame:
    """(cell, components): centred coordinates of every cell."""
    shift = mean @ directions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, x = _flat(batch)
            own = _projected(batch.num_rows, row, at, x, directions) - shift
            yield pa.RecordBatch.from_arrays([batch.column(cell), pa.array(list(own), pa.list_(pa.float64()))], names=[cell, "components"])

    kind = rows.schema[cell].dataType.simpleString()
    return rows.select(cell, "at", "x").mapInArrow(run, f"`{cell}` {kind}, components array<double>")
