"""Approximate nearest neighbours for large tables: several tables of bucketed random projections, probed in order of margin."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.draws import draw_hash
from corrobora.session import cut_lineage, join_statistics

SAMPLE_ROWS = 4096
"""Vectors, chosen by a hash of their id, on which the middle of every projection is fitted; all vectors are indexed."""

MAX_BITS, FLIPPED_BITS = 40, 8
BLOCK_BUCKETS = 8
"""Neighbouring buckets that make one block, the unit of a task's work."""

MAX_HOT_BLOCKS = 100_000
PAIRS_AT_ONCE = 1 << 16
TILE_START, TILE = 1024, 4096
"""Vectors that some queries are compared with at a time: first, and at most."""

QUERIES_IN_TILE = 256
LARGEST = 1e15
"""Length of a vector up to which its products are made in single precision."""

QUERIES_AT_ONCE = 4096
"""Queries of a block whose finds are held before they are cut to the nearest."""

TRIAL_QUERIES = 128
"""Vectors, chosen by a hash of their id, on whose exact neighbours among all the number of probes is tried."""
SALTS = 16


@dataclass(frozen=True)
class Projections:
    """Directions and middles of every table: a vector's bit is set where it lies beyond the middle of a direction."""

    directions: np.ndarray  # tables x dimensions x bits
    middles: np.ndarray  # tables x bits

    @classmethod
    def fitted(cls, sample: np.ndarray, tables: int, bits: int, seed: int) -> Projections:
        """Directions of a table are orthogonal as far as the dimensions go, which keeps its buckets even."""
        dim = sample.shape[1]
        draws = np.random.default_rng(seed).normal(size=(tables, -(-bits // dim), dim, dim))
        directions = np.concatenate([np.zeros((tables, dim, 0)), *np.moveaxis(np.linalg.qr(draws)[0], 1, 0)], axis=2)[:, :, :bits]
        return cls(directions, np.median(sample @ directions, axis=1))

    @property
    def bits(self) -> int:
        return self.directions.shape[2]

    def margins(self, table: int, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions[table] - self.middles[table]

    def homes(self, table: int, vectors: np.ndarray) -> np.ndarray:
        """The bucket of every vector."""
        return (self.margins(table, vectors) > 0).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def probes(self, table: int, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` buckets of every vector that lie nearest by the summed margins of the bits that differ, its own first."""
        margins = self.margins(table, vectors)
        home = (margins > 0).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        width = min(self.bits, FLIPPED_BITS)
        near = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :width]
        subsets = (np.arange(1 << width)[:, None] >> np.arange(width)) & 1
        cost = np.take_along_axis(np.abs(margins), near, axis=1) @ subsets.T
        best = np.argsort(cost, axis=1, kind="stable")[:, :n]
        flips = (subsets[best] * (np.int64(1) << near.astype(np.int64))[:, None, :]).sum(axis=2)
        return home[:, None] ^ flips


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


class Searched:
    """Vectors in which the nearest of others are looked for, exactly.

    Products in single precision, of vectors less their mean, choose with room for their rounding; the chosen pairs are measured by
    differences. A query is compared with tile after tile, and only what may be among its nearest so far is kept.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.dim = ids, vectors, vectors.shape[1]
        self.middle = vectors.mean(axis=0) if len(vectors) else np.zeros(self.dim)
        self.norms = np.zeros(len(vectors))
        self.columns = np.empty((self.dim + 1, len(vectors)), np.float32)
        for at in range(0, len(vectors), TILE):
            apart = vectors[at : at + TILE] - self.middle
            self.norms[at : at + TILE] = (apart * apart).sum(axis=1)
            with np.errstate(over="ignore"):
                self.columns[:-1, at : at + TILE] = apart.T
        with np.errstate(over="ignore"):
            self.columns[-1] = self.norms
        self.largest = np.sqrt(self.norms.max(initial=0.0))

    def nearest(
        self, qids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None, among: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, ...]]:
        """(query ids, ids, distances) of the ``k`` nearest others, some hundreds of queries at a time.

        ``bounds`` are distances beyond which nothing is asked for, and ``among`` tells which of the vectors may be nearer.
        """
        some = among is not None and 2 * np.count_nonzero(among) < len(among)  # a copy of most of them would cost more than it saves
        places = np.flatnonzero(among) if some else np.arange(len(self.ids))
        columns = self.columns[:, places] if some else self.columns
        tiled = len(places) > TILE_START > 2 * k and self.largest < LARGEST
        for i in range(0, len(qids), QUERIES_IN_TILE):
            own, q = qids[i : i + QUERIES_IN_TILE], queries[i : i + QUERIES_IN_TILE]
            bound = np.full(len(own), np.inf) if bounds is None else bounds[i : i + QUERIES_IN_TILE]
            found = self._chosen(q, k, bound, columns) if tiled else None
            if found is None:
                yield from self._by_differences(own, q, k, places)
                continue
            row, col = found
            col = places[col]
            other = own[row] != self.ids[col]
            yield self._measured(own, q, row[other], col[other], k)

    def _chosen(self, q: np.ndarray, k: int, bound: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of queries and columns that hold their ``k`` nearest others; none where so many are equally near that tiles do not pay."""
        apart = q - self.middle
        size = (apart * apart).sum(axis=1)
        if not (size < LARGEST * LARGEST).all():
            return None
        left = np.concatenate([-2 * apart, np.ones((len(q), 1))], axis=1).astype(np.float32)
        # a product and what it stands for, the squared distance less the query's norm, differ by no more than this
        slack = (self.dim + 8) * 2.0**-23 * (2 * np.sqrt(size) * self.largest + self.largest**2) + 1e-30
        limit = np.square(bound * (1 + 1e-9) + 1e-9) - size + slack
        best = np.full((len(q), k + 1), np.inf)  # one of them is the row itself
        rows, cols, values, n, at, width = [], [], [], columns.shape[1], 0, TILE_START
        while at < n:
            tile = left @ columns[:, at : at + width]
            if at == 0:
                limit = np.minimum(limit, np.partition(tile, k, axis=1)[:, k] + 2 * slack)
            near = tile <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
            row, col = np.divmod(true_places(near), tile.shape[1])
            if len(row) > tile.size // 8 + (k + 1) * len(q):
                return None
            value = tile[row, col].astype(float)
            rows.append(row), cols.append(col + at), values.append(value)
            best = _least(best, row, value)
            limit = np.minimum(limit, best[:, k] + 2 * slack)
            at, width = at + tile.shape[1], min(TILE, 2 * width)
        row, col, value = (np.concatenate(x) for x in (rows, cols, values))
        keep = value <= limit[row]
        return row[keep], col[keep]

    def _measured(self, own: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        distance = np.empty(len(row))
        for at in range(0, len(row), PAIRS_AT_ONCE):  # where many are equally near, they are many
            apart = q[row[at : at + PAIRS_AT_ONCE]] - self.vectors[col[at : at + PAIRS_AT_ONCE]]
            distance[at : at + PAIRS_AT_ONCE] = np.sqrt((apart * apart).sum(axis=1))
        order = np.lexsort((self.ids[col], distance, row))
        row, col, distance = row[order], col[order], distance[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return own[row[keep]], self.ids[col[keep]], distance[keep]

    def _by_differences(self, qids: np.ndarray, queries: np.ndarray, k: int, places: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The same from products in double precision, for few vectors and for those that single precision cannot tell apart."""
        vectors, ids = self.vectors[places], self.ids[places]
        norms = (vectors * vectors).sum(axis=1)
        step = max(1, min(512, 4_000_000 // max(1, len(ids))))
        for i in range(0, len(qids), step):
            q, own = queries[i : i + step], qids[i : i + step]
            size = (q * q).sum(axis=1)[:, None] + norms
            square = size - 2 * (q @ vectors.T)
            slack = 1e-12 * self.dim * size
            square[own[:, None] == ids[None, :]] = np.inf
            place = min(k, len(ids)) - 1
            bound = np.partition(square + slack, place, axis=1)[:, place]
            row, col = np.nonzero((square - slack <= bound[:, None]) & np.isfinite(square))
            yield self._measured(own, q, row, places[col], k)


def true_places(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true values, looked for eight at a time."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64))
    at, place = np.nonzero(flat.reshape(-1, 8)[eight])
    return eight[at] * 8 + place


def _least(best: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least values of every row among those it has and new ones, in ascending order."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < best.shape[1]
    new = np.full(best.shape, np.inf)
    new[row[keep], place[keep]] = value[keep]
    return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, : best.shape[1]]


def nearest_pairs(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query ids, ids, distances) of the ``k`` nearest others, some hundreds of queries at a time; see :class:`Searched`."""
    yield from Searched(ids, vectors).nearest(qids, queries, k)


def _distinct(data: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the least id that has their vector, and per distinct vector its first ``k + 1`` ids.

    A vector may fill any share of the rows: its ids are cut to the first ones in parts before they meet.
    """
    salted = data.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    some = salted.withColumn("_n", first("vec", "_salt")).filter(F.col("_n") <= k + 1)
    some = some.withColumn("_n", first("vec")).filter(F.col("_n") <= k + 1)
    reps = cut_lineage(some.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("copies")).withColumn("rep", F.col("copies")[0]))
    members = join_statistics(data, reps.select("vec", "rep"), ["vec"]).select("id", "rep")
    return members, reps


def _trial(reps: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the trial queries and of their exact neighbours among all, pair by pair."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["rep"].to_numpy()
            found = list(nearest_pairs(ids, _matrix(pdf["vec"]), qids, queries, k)) if len(pdf) else []
            src, dst, distance = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
            yield pd.DataFrame({"src": src, "dst": dst, "distance": distance})

    near = Window.partitionBy("src").orderBy("distance", "dst")
    best = reps.select("rep", "vec").mapInPandas(measured, "src long, dst long, distance double")
    best = best.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k)
    pairs = best.join(reps.select(F.col("rep").alias("dst"), "vec"), "dst").select("src", "vec").collect()
    place = {q: i for i, q in enumerate(qids.tolist())}
    return queries[[place[r["src"]] for r in pairs]], np.array([r["vec"] for r in pairs], dtype=float).reshape(len(pairs), queries.shape[1])


def _probes_for(index: Projections, asked: np.ndarray, true: np.ndarray, goal: float) -> int | None:
    """The least number of probes by which ``goal`` of the true pairs meet in a table; none if all probes are too few."""
    if not len(asked):
        return 1
    most = 1 << min(index.bits, FLIPPED_BITS)
    least = np.full(len(asked), most + 1)
    for t in range(len(index.directions)):
        met = index.probes(t, asked, most) == index.homes(t, true)[:, None]
        least = np.minimum(least, np.where(met.any(axis=1), met.argmax(axis=1) + 1, most + 1))
    enough = int(np.sort(least)[min(len(least) - 1, math.ceil(goal * len(least)) - 1)])
    return enough if enough <= most else None


def approximate_neighbours(
    df: DataFrame,
    key: str,
    features: str,
    k: int,
    tables: int = 8,
    probes: int = 8,
    bucket_rows: int = 1024,
    seed: int = 1,
    queries: DataFrame | None = None,
    recall_goal: float = 0.97,
) -> DataFrame:
    """Up to ``k`` near other rows of every row (or of those whose key is in ``queries``), as ``(src, dst, distance, rank)``.

    Every distinct vector is filed in one bucket of each table; buckets grow in number with the rows, so one holds about
    ``bucket_rows``. A query looks into the ``probes`` buckets of each table that lie nearest, so it meets about
    ``tables * probes * bucket_rows`` vectors however many there are, and more probes give more recall. ``probes`` is the least number: for some vectors the exact neighbours are
    found among all, and probes are added, or buckets made larger, until ``recall_goal`` of those lie in the probed buckets. Distances are exact, equal ones
    are ordered by id. Copies of one vector are searched once and always found. A block of buckets that many vectors
    share is dealt to several tasks, with each part's queries; none is left out. Rows whose key or vector is null, or whose vector has a null or
    non-finite component, take no part; vectors must have one length.
    """
    spark = df.sparkSession
    clean = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    data = df.select(F.col(key).cast("long").alias("id"), F.col(features).alias("vec")).filter(clean).filter(finite)
    members, reps = _distinct(data, k)
    n = reps.count()
    chosen = reps.orderBy(draw_hash(F.lit(seed), F.col("rep")), "rep").limit(SAMPLE_ROWS).select("rep", "vec").collect()
    sample = [r["vec"] for r in chosen]
    if not sample:
        return spark.createDataFrame([], "src bigint, dst bigint, distance double, rank int")
    bits = min(MAX_BITS, max(0, math.ceil(math.log2(n / bucket_rows))))
    fitted = np.array(sample, dtype=float)
    trial = _trial(reps, np.array([r["rep"] for r in chosen[:TRIAL_QUERIES]]), fitted[:TRIAL_QUERIES], k)
    while True:
        index = Projections.fitted(fitted, tables, bits, seed)
        enough = _probes_for(index, *trial, recall_goal)
        if enough is not None or bits == 0:
            break
        bits -= 1
    probes = max(probes, enough or 1)
    low = min(bits, int(math.log2(BLOCK_BUCKETS)))
    vec_type = reps.schema["vec"].dataType.simpleString()

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = _matrix(pdf["vec"])
            for t in range(tables if len(pdf) else 0):
                block, count = np.unique(index.homes(t, vectors) >> low, return_counts=True)
                yield pd.DataFrame({"tab": t, "block": block, "n": count})

    # Blocks beyond this size are at most MAX_HOT_BLOCKS, as all blocks of all tables hold tables * n vectors.
    hot_rows = max(4 * bucket_rows * BLOCK_BUCKETS, -(-tables * n // MAX_HOT_BLOCKS))
    counted = reps.mapInPandas(sizes, "tab int, block long, n long").groupBy("tab", "block").agg(F.sum("n").alias("n"))
    parts = {(r["tab"], r["block"]): -(-r["n"] // hot_rows) for r in counted.filter(F.col("n") > hot_rows).collect()}

    def dealt(t: int, own: np.ndarray, block: np.ndarray, pdf: pd.DataFrame, mine: str, other: str) -> pd.DataFrame:
        """Rows ``own`` to the block's parts: one part by the row's id on its own side, all parts on the other."""
        fan = np.array([parts.get((t, b), 1) for b in block.tolist()], dtype=np.int64)
        at = np.repeat(np.arange(len(own)), fan)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(fan) - fan, fan)
        ids, vecs = pdf["rep"].to_numpy()[own], pdf["vec"].to_numpy()[own]
        return pd.DataFrame({"tab": t, "block": block[at], mine: (ids % 1_000_003 % fan)[at], other: turn, "id": ids[at], "vec": vecs[at]})

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = _matrix(pdf["vec"])
            for t in range(tables if len(pdf) else 0):
                yield dealt(t, np.arange(len(pdf)), index.homes(t, vectors) >> low, pdf, "part", "chunk")

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = _matrix(pdf["vec"])
            for t in range(tables if len(pdf) else 0):
                block = np.sort(index.probes(t, vectors, probes) >> low, axis=1)
                new = np.ones(block.shape, dtype=bool)
                new[:, 1:] = block[:, 1:] != block[:, :-1]
                yield dealt(t, np.nonzero(new)[0], block[new], pdf, "chunk", "part")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            t = int(left["tab"].iloc[0])
            order = np.argsort(right["id"].to_numpy(), kind="stable")
            ids, vectors = right["id"].to_numpy()[order], _matrix(right["vec"])[order]
            homes = index.homes(t, vectors)
            qids, asked = left["id"].to_numpy(), _matrix(left["vec"])
            buckets = [(bucket, homes == bucket) for bucket in np.unique(homes)]
            for at in range(0, len(qids), QUERIES_AT_ONCE):
                some, own = asked[at : at + QUERIES_AT_ONCE], qids[at : at + QUERIES_AT_ONCE]
                wanted = index.probes(t, some, probes)
                near = []
                for bucket, inside in buckets:
                    who = (wanted == bucket).any(axis=1)
                    near += list(nearest_pairs(ids[inside], vectors[inside], own[who], some[who], k))
                if near:
                    src, dst, distance = (np.concatenate(x) for x in zip(*near))
                    order = np.lexsort((dst, distance, src))
                    src, dst, distance = src[order], dst[order], distance[order]
                    keep = np.arange(len(src)) - np.searchsorted(src, src) < k
                    found.append((src[keep], dst[keep], distance[keep]))
        src, dst, distance = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        return pd.DataFrame({"src": src, "dst": dst, "distance": distance})

    keys = ["tab", "block", "part", "chunk"]
    schema = f"tab int, block long, part long, chunk long, id long, vec {vec_type}"
    own = reps.select("rep", "vec")
    if queries is not None:
        members = members.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
        own = own.join(members.select("rep").distinct(), "rep", "left_semi")
    asked, objects = own.mapInPandas(routed, schema), reps.select("rep", "vec").mapInPandas(filed, schema)
    pairs = asked.groupBy(*keys).cogroup(objects.groupBy(*keys)).applyInPandas(search, "src long, dst long, distance double")
    near = Window.partitionBy("src").orderBy("distance", "dst")
    best = pairs.groupBy("src", "dst").agg(F.min("distance").alias("distance")).withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k)

    # A vector's own copies are its nearest; k + 1 of them are enough, as one is the row itself.
    copies = reps.select("rep", "copies")
    listed = best.join(copies.withColumnRenamed("rep", "dst"), "dst").select("src", "distance", F.explode("copies").alias("dst"))
    listed = listed.unionByName(copies.select(F.col("rep").alias("src"), F.lit(0.0).alias("distance"), F.explode("copies").alias("dst")))
    listed = listed.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k + 1)
    whole = listed.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("near")).withColumnRenamed("src", "rep")
    others = F.slice(F.filter("near", lambda x: x["dst"] != F.col("id")), 1, k)
    return (
        join_statistics(members, whole, ["rep"])
        .select("id", F.posexplode(others).alias("_at", "_x"))
        .select(F.col("id").alias("src"), F.col("_x.dst").alias("dst"), F.col("_x.distance").alias("distance"), (F.col("_at") + 1).alias("rank"))
    )


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many true pairs there are, how many of them were found, and the share; 1 if there are none."""
    hits = truth.select("src", "dst").join(found.select("src", "dst").withColumn("_hit", F.lit(1)), ["src", "dst"], "left")
    out = hits.agg(F.count(F.lit(1)).alias("n_true"), F.count("_hit").alias("n_found"))
    return out.withColumn("recall", F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_true")))
