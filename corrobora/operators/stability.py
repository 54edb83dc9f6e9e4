"""Stability of winners over many draws at once: cells sampled without replacement and libraries thinned.

No row is repeated for a draw. A cell has one bitmap of the draws it is in; counts meet their cell once; sums are
vectors over draws; and a gene's scores, winners and tallies of all draws are made where its counts meet.

Draw ``rep`` of a scenario orders the cells of a (donor, type) by a 64-bit hash and takes the first k. The k-th
hash is found exactly: each task counts the hashes below a narrow window around its expected place and passes on those
inside. What comes to the driver is bounded by donors x types x scenarios x draws: the design, the k-th hashes and
the library totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.tails import log_gamma
from corrobora.operators.neighbours import true_places
from corrobora.session import cut_lineage

CELL_N, CELL_FRACTION, UMI_FRACTION = "cell_n", "cell_fraction", "umi_fraction"
WIDTH = 6.0
"""Half width of the window around a k-th hash in standard deviations; doubled as long as one lies outside."""

DRAWS_AT_ONCE = 20
"""Draws of a stratum whose k-th hashes one task looks for."""

GUIDE_BITS = 10
GUIDE = 1 << GUIDE_BITS
"""Parts of the unit interval in which a binomial quantile is looked up."""

MOST_DISTRIBUTIONS = 1 << 13

HELD_HASHES = 1 << 21
CELLS_AT_ONCE = 64
HASHED_AT_ONCE = 1 << 14
GENES_AT_ONCE = 128
GENES_SCORED = 16
"""Genes whose scores of all draws are held at once."""

SPARSE = 16
"""Scores are made one by one where fewer than one of so many counts can be other than zero."""

SCORED_AT_ONCE = 64
"""Draws of a scenario that are scored before it is asked whether the others matter, a multiple of 8."""

ROWS_AT_ONCE = 512
COMBINED_ROWS = 64
"""Rows of one gene and group in a batch from which they go on as one vector of sums."""

SALTS = 64
TIE = 1e-10
MOST_FACTORS = 48
"""Donors whose counts per million, a million at most, can be multiplied."""

TOPS = "map<string, string>"
"""Baseline type of a gene by the types compared."""

_U = np.uint64


@dataclass(frozen=True)
class Scenario:
    """A way to draw: ``parameter`` cells, a fraction of the cells, or a fraction of every library's counts."""

    name: str
    operation: str
    parameter: float
    types: tuple[str, ...]


def mixed(x: np.ndarray) -> np.ndarray:
    """Uniform 64 bits from 64-bit labels: two rounds of shift and multiplication."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Hashes:
    """:func:`mixed` bits of rows and draws, made in two buffers that stay in a cache."""

    def __init__(self) -> None:
        self.buffers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, base: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Rows x draws, valid until the next call."""
        if len(self.buffers.get(len(labels), ([], []))[0]) < len(base):
            self.buffers[len(labels)] = np.empty((len(base), len(labels)), _U), np.empty((len(base), len(labels)), _U)
        x, y = (b[: len(base)] for b in self.buffers[len(labels)])
        np.bitwise_xor(base[:, None], labels[None, :], out=x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            np.right_shift(x, _U(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            if factor is not None:
                np.multiply(x, _U(factor), out=x)
        return x


def word(*labels: object) -> int:
    """Unsigned 64 bits of the MD5 of labels."""
    return int(hashlib.md5("|".join(map(str, labels)).encode()).hexdigest()[:16], 16)


@lru_cache(maxsize=256)
def words(seed: int, scenario: str, reps: int) -> np.ndarray:
    """One label for each draw of a scenario."""
    return np.array([word(seed, scenario, r) for r in range(reps)], _U)


def label_hash(*labels: Column) -> Column:
    """The same 64 bits as :func:`word` for columns, as a signed number."""
    hexa = F.md5(F.concat_ws("|", *[c.cast("string") for c in labels]))
    half = lambda at: F.conv(F.substring(hexa, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def design(cells: DataFrame, scenarios: Sequence[Scenario], donors: Sequence[str]) -> DataFrame:
    """Per scenario, donor and type of its set: cells there are and cells to draw, also where there are none."""
    spark = cells.sparkSession
    asked = [(s.name, s.operation, float(s.parameter), ";".join(s.types), d, t) for s in scenarios for d in donors for t in s.types]
    wanted = spark.createDataFrame(asked, "scenario string, operation string, parameter double, comparison_types string, donor string, cell_type string")
    size = cells.groupBy("donor", "cell_type").agg(F.count(F.lit(1)).alias("available_cells"))
    n = F.col("available_cells")
    selected = (
        F.when(F.col("operation") == CELL_N, F.col("parameter"))
        .when(F.col("operation") == CELL_FRACTION, F.greatest(F.lit(1), F.floor(n * F.col("parameter"))))
        .otherwise(F.greatest(F.lit(1), n))
    )
    placed = wanted.join(size, ["donor", "cell_type"], "left").withColumn("available_cells", F.coalesce("available_cells", F.lit(0)))
    return placed.withColumn("selected_cells", selected.cast("long")).withColumn("feasible", F.col("selected_cells") <= n)


class Plan:
    """A design at work: which scenarios can be drawn, and numbers for groups, scenarios and draws.

    A scenario with too few cells in any group is not drawn, as a missing group is no zero.
    """

    def __init__(self, table: DataFrame, scenarios: Sequence[Scenario], donors: Sequence[str], reps: int, seed: int) -> None:
        rows = table.select("scenario", "donor", "cell_type", "available_cells", "selected_cells", "feasible").collect()
        short = {r["scenario"] for r in rows if not r["feasible"]}
        self.scenarios = [s for s in scenarios if s.name not in short]
        self.sampled = [s for s in self.scenarios if s.operation != UMI_FRACTION]
        self.thinned = [s for s in self.scenarios if s.operation == UMI_FRACTION]
        self.donors, self.reps, self.seed = list(donors), reps, seed
        self.types = list(dict.fromkeys(t for s in scenarios for t in s.types))
        self.groups = [(d, t) for d in self.donors for t in self.types]
        place = {g: i for i, g in enumerate(self.groups)}
        index = {s.name: i for i, s in enumerate(self.sampled)}
        self.strata = {
            (place[r["donor"], r["cell_type"]], index[r["scenario"]]): (r["available_cells"], r["selected_cells"])
            for r in rows
            if r["scenario"] in index
        }
        self.words = [words(seed, s.name, reps) for s in self.sampled]
        self.bytes = -(-reps // 8)

    def group(self, donor: Column, cell_type: Column) -> Column:
        """Number of a group; null if it is in no scenario."""
        i, j = (F.array_position(F.array(*map(F.lit, of)), c) for of, c in ((self.donors, donor), (self.types, cell_type)))
        return F.when((i > 0) & (j > 0), (i - 1) * len(self.types) + j - 1).cast("int")

    def window(self, group: int, scenario: int, width: float) -> tuple[np.uint64, np.uint64]:
        n, k = self.strata[group, scenario]
        spread = width * np.sqrt(k * max(0.0, 1 - k / n)) + 2 * width
        ends = max(0.0, (k - spread) / n), min(1.0, (k + spread) / n)
        return _U(min(2**64 - 1, int(ends[0] * 2.0**64))), _U(min(2**64 - 1, int(ends[1] * 2.0**64)))


def _by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cells of a batch by group, some at a time: group, rows, labels."""
    group = batch.column("group").to_numpy()
    base = batch.column("base").to_numpy().view(_U)
    order = np.argsort(group, kind="stable")
    cuts = [*np.flatnonzero(np.diff(group[order], prepend=-1)), len(order)]
    for lo, hi in zip(cuts, cuts[1:]):
        for at in range(lo, hi, CELLS_AT_ONCE):
            rows = order[at : min(hi, at + CELLS_AT_ONCE)]
            yield int(group[rows[0]]), rows, base[rows]


def _kth_hashes(cells: DataFrame, plan: Plan) -> dict[tuple[int, int], np.ndarray]:
    """Per group and scenario the k-th smallest hash of every draw."""
    found: dict[tuple[int, int], np.ndarray] = {}
    width = WIDTH
    while len(found) < len(plan.strata):
        left = {key: plan.window(*key, width) for key in plan.strata if key not in found}
        chunks = [(lo, min(plan.reps, lo + DRAWS_AT_ONCE)) for lo in range(0, plan.reps, DRAWS_AT_ONCE)]

        def told(batches: Iterator[pa.RecordBatch], left=left, chunks=chunks) -> Iterator[pa.RecordBatch]:
            below: dict[tuple[int, int], np.ndarray] = {}
            inside: dict[tuple[int, int], list] = {}
            held, hashes = 0, _Hashes()

            def flush() -> pa.RecordBatch:
                out = []
                for key, counts in below.items():
                    reps, hashes = (np.concatenate(x) for x in zip(*inside[key], strict=True))
                    order = np.argsort(reps, kind="stable")
                    cuts = np.searchsorted(reps[order], [c[0] for c in chunks] + [plan.reps])
                    for i, (lo, hi) in enumerate(chunks):
                        own = order[cuts[i] : cuts[i + 1]]
                        out.append((*key, i, counts[lo:hi].tobytes(), reps[own].astype(np.int32).tobytes(), hashes[own].tobytes()))
                below.clear(), inside.clear()
                types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                cols = list(zip(*out, strict=True)) or [[]] * 6
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["group", "scenario", "chunk", "below", "reps", "hashes"])

            for batch in batches:
                for group, _, base in _blocks(batch):
                    for s, labels in enumerate(plan.words):
                        if (group, s) not in left:
                            continue
                        lo, hi = left[group, s]
                        h = hashes.of(base, labels)
                        counts = below.setdefault((group, s), np.zeros(plan.reps, np.int64))
                        if lo > 0:
                            counts += (h < lo).view(np.uint8).sum(axis=0, dtype=np.uint8)
                        near = np.flatnonzero(h - lo <= hi - lo)  # below the window the difference wraps round
                        inside.setdefault((group, s), []).append((near % plan.reps, h.ravel()[near]))
                        held += len(near)
                if held > HELD_HASHES:
                    yield flush()
                    held = 0
            yield flush()

        def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, below, reps, hashes = None, None, [], []

            def kth() -> pa.RecordBatch:
                rows = []
                if now is not None:
                    group, s, chunk = now
                    k = plan.strata[group, s][1]
                    all_reps, all_hashes = np.concatenate(reps), np.concatenate(hashes)
                    for i, n in enumerate(below.tolist()):
                        rep = chunk * DRAWS_AT_ONCE + i
                        own = all_hashes[all_reps == rep]
                        good = n < k <= n + len(own)
                        rows.append((group, s, rep, int(np.partition(own, k - n - 1)[k - n - 1].astype(np.int64)) if good else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                    names=["group", "scenario", "rep", "kth"],
                )

            for batch in batches:
                for *key, b, r, h in zip(*(batch.column(c) for c in ("group", "scenario", "chunk", "below", "reps", "hashes")), strict=True):
                    key = tuple(x.as_py() for x in key)
                    if key != now:
                        yield kth()
                        now, below, reps, hashes = key, 0, [], []
                    below = below + np.frombuffer(b.as_py(), np.int64)
                    reps.append(np.frombuffer(r.as_py(), np.int32))
                    hashes.append(np.frombuffer(h.as_py(), _U))
            yield kth()

        near = cells.mapInArrow(told, "group int, scenario int, chunk int, below binary, reps binary, hashes binary")
        kth = _by_key(near, ["group", "scenario", "chunk"]).mapInArrow(settled, "group int, scenario int, rep int, kth long")
        table: dict[tuple[int, int], dict[int, int | None]] = {}
        for r in kth.collect():
            table.setdefault((r["group"], r["scenario"]), {})[r["rep"]] = r["kth"]
        for key, by_rep in table.items():
            if None not in by_rep.values():
                found[key] = np.array([by_rep[i] for i in range(plan.reps)], np.int64).view(_U)
        width *= 2
    return found


def cell_bits(cells: DataFrame, plan: Plan) -> DataFrame:
    """(cell_id, group, total, bits) of the cells in any scenario: per sampled scenario a bitmap of the draws, first draw first.

    ``cells`` has cell_id, donor, cell_type and total, one row for each cell.
    """
    keyed = cells.select("cell_id", plan.group(F.col("donor"), F.col("cell_type")).alias("group"), F.col("total").cast("long"),
        label_hash(F.lit(plan.seed), F.col("donor"), F.col("cell_type"), F.col("cell_id")).alias("base")).filter("group IS NOT NULL")
    kth = _kth_hashes(keyed.select("group", "base"), plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(plan.sampled), plan.bytes), np.uint8)
            for group, rows, base in _blocks(batch):
                for s, labels in enumerate(plan.words):
                    if (group, s) in kth:
                        bits[rows, s] = np.packbits(hashes.of(base, labels) <= kth[group, s][None, :], axis=1)
            flat = pa.array([b.tobytes() for b in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell_id", "group", "total")), flat], names=["cell_id", "group", "total", "bits"])

    id_type = keyed.schema["cell_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"cell_id {id_type}, group int, total long, bits binary")


def drawn_cells(bits: DataFrame, plan: Plan) -> DataFrame:
    """Per cell and sampled scenario of its group: in how many draws it is, and the sum of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(plan.reps)
        for batch in batches:
            group = batch.column("group").to_numpy()
            draws = _unpacked(batch.column("bits"), plan)
            rows, which = np.nonzero(np.array([[(g, s) in plan.strata for s in range(len(plan.sampled))] for g in group]).reshape(len(group), -1))
            own = draws[rows, which]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell_id").take(pa.array(rows)), pa.array(group[rows], pa.int32()), pa.array([plan.sampled[s].name for s in which], pa.string()),
                 pa.array(own.sum(axis=1, dtype=np.int64)), pa.array(own @ numbers)],
                names=["cell_id", "group", "scenario", "n_draws", "draw_sum"],
            )

    id_type = bits.schema["cell_id"].dataType.simpleString()
    out = bits.select("cell_id", "group", "bits").mapInArrow(run, f"cell_id {id_type}, group int, scenario string, n_draws long, draw_sum long")
    named = F.array(*[F.struct(F.lit(d).alias("donor"), F.lit(t).alias("cell_type")) for d, t in plan.groups])
    return out.withColumn("g", F.get(named, F.col("group"))).select("scenario", "g.donor", "g.cell_type", "cell_id", "n_draws", "draw_sum")


def _unpacked(bits: pa.Array, plan: Plan) -> np.ndarray:
    """Draws as zeros and ones: rows x sampled scenarios x draws."""
    packed = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), len(plan.sampled), plan.bytes)
    return np.unpackbits(packed, axis=2, count=plan.reps)


def _grouped_sums(keys: np.ndarray, values: np.ndarray, bits: pa.Array, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` over each key's rows for every draw: the different keys, and keys x (scenarios x draws)."""
    different, place = np.unique(keys, return_inverse=True)
    width = len(plan.sampled) * plan.reps
    out = np.zeros((len(different), width), np.int64)
    order = np.argsort(place, kind="stable")
    for at in range(0, len(order), ROWS_AT_ONCE):
        rows = order[at : at + ROWS_AT_ONCE]
        draws = _unpacked(bits.take(pa.array(rows)), plan).reshape(len(rows), width)
        starts = np.flatnonzero(np.diff(place[rows], prepend=-1))
        out[place[rows[starts]]] += np.add.reduceat(draws * values[rows][:, None], starts, axis=0)
    return different, out


def vector_total(df: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Sums of ``vector`` (n 64-bit integers) of each ``group`` over all tasks, in two steps; one for each group comes to the driver."""

    def add(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None
            out: list[tuple] = []
            for batch in batches:
                for *key, v in zip(*(batch.column(c) for c in [*names, "vector"]), strict=True):
                    key = tuple(x.as_py() for x in key)
                    if key != now:
                        if now is not None:
                            out.append((*now, total.tobytes()))
                        now, total = key, np.zeros(n, np.int64)
                    total += np.frombuffer(v.as_py(), np.int64)
            if now is not None:
                out.append((*now, total.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * (len(names) + 1)
            types = [pa.int32()] * len(names) + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*names, "vector"])

        return run

    salted = df.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    some = _by_key(salted, ["group", "salt"]).mapInArrow(add(["group", "salt"]), "group int, salt int, vector binary")
    whole = _by_key(some.select("group", "vector"), ["group"]).mapInArrow(add(["group"]), "group int, vector binary")
    return {r["group"]: np.frombuffer(r["vector"], np.int64) for r in whole.collect()}


def library_totals(bits: DataFrame, plan: Plan) -> np.ndarray:
    """Counts of all drawn cells: groups x sampled scenarios x draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            groups, sums = _grouped_sums(batch.column("group").to_numpy(), batch.column("total").to_numpy(), batch.column("bits"), plan)
            for g, s in zip(groups.tolist(), sums, strict=True):
                total[g] = total[g] + s if g in total else s
        vectors = [v.tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(vectors, pa.binary())], names=["group", "vector"])

    n = len(plan.sampled) * plan.reps
    out = np.zeros((len(plan.groups), len(plan.sampled), plan.reps), np.int64)
    for g, v in vector_total(bits.select("group", "total", "bits").mapInArrow(run, "group int, vector binary"), n).items():
        out[g] = v.reshape(len(plan.sampled), plan.reps)
    return out


class Binomials:
    """Binomial quantiles of uniform numbers; the distribution of a count is made once.

    Equal parts of the unit interval know their quantile where no step of the distribution falls inside; only in the others the steps are
    followed, from the first one inside. All distributions stand in one table, so rows of different counts are looked up together.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[int, float], int] = {}
        self.table = np.empty((64, GUIDE), np.int32)  # the quantile of a part; where it is open, -1 less the steps below it
        self.firsts, self.ends = np.empty(64, np.int64), np.zeros(65, np.int64)
        self.steps = np.empty(1 << 12)

    def cdf(self, n: int, p: float) -> tuple[int, np.ndarray]:
        """First value and running sums of the probabilities around the mean; what lies outside has less than 1e-30."""
        spread = 12 * np.sqrt(n * p * (1 - p)) + 40
        lo, hi = max(0, int(n * p - spread)), min(n, int(n * p + spread))
        k = np.arange(lo, hi + 1, dtype=float)
        logs = log_gamma(np.array([n + 1.0]))[0] - log_gamma(k + 1) - log_gamma(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p)
        return lo, np.cumsum(np.exp(logs))

    def _place(self, n: int, p: float) -> int:
        """Row of the table in which a distribution stands."""
        at = self.known.get((n, p))
        if at is not None:
            return at
        at = len(self.known)
        first, cdf = self.cdf(n, p) if n > 0 else (0, np.ones(1))
        if at == len(self.table):
            self.table, self.firsts = np.concatenate([self.table, np.empty_like(self.table)]), np.concatenate([self.firsts, self.firsts])
            self.ends = np.concatenate([self.ends, np.zeros(at, np.int64)])
        lo = self.ends[at]
        hi = self.ends[at + 1] = lo + len(cdf)
        while hi > len(self.steps):
            self.steps = np.concatenate([self.steps, np.empty_like(self.steps)])
        parts = np.arange(GUIDE + 1) / GUIDE
        least, most = np.searchsorted(cdf, parts[:-1], "right"), np.searchsorted(cdf, parts[1:], "left")
        exact = (least == most) & (first + least < 2**31)
        self.firsts[at], self.steps[lo:hi] = first, cdf
        self.table[at] = np.where(exact, np.minimum(n, first + least), -1 - least) if n > 0 else 0
        self.known[n, p] = at
        return at

    def guide(self, n: int, p: float) -> np.ndarray:
        """The quantile in each part of the unit interval, negative where it takes a search."""
        return self.table[self._place(n, p)]

    def rows(self, n: np.ndarray, p: float) -> np.ndarray:
        """Rows of the table for counts, valid until the next call for other counts."""
        values, which = np.unique(n, return_inverse=True)
        if len(self.known) + len(values) > MOST_DISTRIBUTIONS:
            self._forget()
        return np.array([self._place(value, p) for value in values.tolist()], np.int64)[which]

    def _settled(self, n: np.ndarray, row: np.ndarray, out: np.ndarray, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Looked-up draws, of which those at the flat places ``at`` are open and belong to the numbers ``u``."""
        if not len(at):
            return out
        out = out if n.max() < 2**31 else out.astype(np.int64)
        flat, own = out.ravel(), at // out.shape[1]
        begin, end, first, most = (x[own] for x in (self.ends[row], self.ends[row + 1], self.firsts[row], n))
        step, left = begin - 1 - flat[at], np.arange(len(at))
        for _ in range(2):  # most numbers lie next to the first step
            left = left[step[left] < end[left]]
            left = left[self.steps[step[left]] <= u[left]]
            step[left] += 1
        low, high, sought = step[left], end[left], u[left]
        while (low < high).any():
            middle = np.minimum((low + high) >> 1, high - 1)
            above = (low < high) & (self.steps[middle] <= sought)
            low, high = np.where(above, middle + 1, low), np.where(above | (low >= high), high, middle)
        step[left] = low
        flat[at] = np.minimum(most, first + step - begin)
        return out

    def draw(self, n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
        """Per row of ``u`` the draws for its count ``n``."""
        if p >= 1:
            return np.broadcast_to(n[:, None], u.shape).copy()
        row = self.rows(n, p)
        out = self.table.ravel().take((u * GUIDE).astype(np.int64) + (row * GUIDE)[:, None])
        at = np.flatnonzero(out < 0)
        return self._settled(n, row, out, at, u.ravel()[at])

    def draw_keyed(self, n: np.ndarray, p: float, base: np.ndarray, labels: np.ndarray, hashes: _Hashes) -> np.ndarray:
        """The same for the uniform numbers that the upper 52 bits of the hashes of rows and draws stand for."""
        if p >= 1:
            return np.broadcast_to(n[:, None], (len(n), len(labels))).copy()
        row = self.rows(n, p)
        out, open_, rest = np.empty((len(n), len(labels)), np.int32), [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(CELLS_AT_ONCE, HASHED_AT_ONCE // max(1, len(labels)))
        for at in range(0, len(n), step):
            h, own = hashes.of(base[at : at + step], labels), out[at : at + step]
            place = (h >> _U(64 - GUIDE_BITS)).view(np.int64)
            place += (row[at : at + step] * GUIDE)[:, None]
            self.table.ravel().take(place, out=own, mode="clip")
            found = true_places(own < 0)
            open_.append(found + at * len(labels))
            rest.append((h.ravel()[found] >> _U(12)) * 2.0**-52)
        return self._settled(n, row, out, np.concatenate(open_), np.concatenate(rest))


def thinned_once(n: np.ndarray, labels: np.ndarray, plan: Plan, scenario: Scenario, binomials: Binomials, lo: int, hi: int) -> np.ndarray:
    """Counts left of ``n`` in some draws of a scenario, keyed by a label for each: rows x draws."""
    drawn, hashes, out = words(plan.seed, scenario.name, plan.reps)[lo:hi], _Hashes(), np.empty((len(n), hi - lo))
    for at in range(0, len(n), ROWS_AT_ONCE):
        some = slice(at, at + ROWS_AT_ONCE)
        out[some] = binomials.draw_keyed(n[some], scenario.parameter, labels[some], drawn, hashes)
    return out


def thinned(n: np.ndarray, labels: np.ndarray, plan: Plan, binomials: Binomials) -> np.ndarray:
    """Counts left of ``n`` in every thinned scenario and draw, keyed by a label for each: rows x scenarios x draws."""
    out = np.zeros((len(n), len(plan.thinned), plan.reps), np.int64)
    for s, scenario in enumerate(plan.thinned):
        out[:, s] = thinned_once(n, labels, plan, scenario, binomials, 0, plan.reps)
    return out


def thinned_totals(sums: DataFrame, totals: DataFrame, plan: Plan) -> np.ndarray:
    """Counts left of whole libraries: groups x thinned scenarios x draws.

    ``sums`` has gene_id, donor, cell_type and the count ``umi`` of every gene to be scored; ``totals`` has donor,
    cell_type and the library ``total``. What a library has beside those genes is thinned as one more count.
    """
    listed = plan.group(F.col("donor"), F.col("cell_type")).alias("group")
    label = label_hash(F.lit(plan.seed), F.col("donor"), F.col("cell_type"), F.col("gene_id")).alias("base")
    rows = sums.select(listed, label, F.col("umi").cast("long").alias("n"))
    held = sums.groupBy("donor", "cell_type").agg(F.sum("umi").alias("_held"))
    other = totals.join(held, ["donor", "cell_type"], "left").withColumn("n", F.col("total") - F.coalesce("_held", F.lit(0)))
    beyond = other.select(
        listed, label_hash(F.lit(plan.seed), F.col("donor"), F.col("cell_type"), F.lit("other")).alias("base"),
        F.when(F.col("n") < 0, F.raise_error(F.lit("counts of the scored genes exceed the library"))).otherwise(F.col("n")).cast("long").alias("n"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binomials, hashes, total = Binomials(), _Hashes(), {}
        drawn = [words(plan.seed, scenario.name, plan.reps) for scenario in plan.thinned]
        for batch in batches:
            group, n = batch.column("group").to_numpy(), batch.column("n").to_numpy()
            base = batch.column("base").to_numpy().view(_U)
            order = np.lexsort((n, group))
            cuts = [*np.flatnonzero(np.diff(group[order], prepend=-1)), len(order)]
            for lo, hi in zip(cuts, cuts[1:]):
                own = total.setdefault(int(group[order[lo]]), np.zeros(len(plan.thinned) * plan.reps, np.int64)).reshape(len(plan.thinned), -1)
                for at in range(lo, hi, ROWS_AT_ONCE):
                    rows = order[at : min(hi, at + ROWS_AT_ONCE)]
                    for s, scenario in enumerate(plan.thinned):
                        own[s] += binomials.draw_keyed(n[rows], scenario.parameter, base[rows], drawn[s], hashes).sum(axis=0, dtype=np.int64)
        vectors = [v.tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(vectors, pa.binary())], names=["group", "vector"])

    out = np.zeros((len(plan.groups), len(plan.thinned), plan.reps), np.int64)
    if plan.thinned:
        parts = rows.unionByName(beyond).filter("group IS NOT NULL AND n > 0").mapInArrow(run, "group int, vector binary")
        for g, v in vector_total(parts, len(plan.thinned) * plan.reps).items():
            out[g] = v.reshape(len(plan.thinned), plan.reps)
    return out


def _combined(plan: Plan):
    """Rows of a gene and group that are many in a batch become one row with their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gene, group = batch.column("gene_id").to_numpy(), batch.column("group").to_numpy()
            umi = batch.column("umi").to_numpy()
            key = np.unique(gene, return_inverse=True)[1] * len(plan.groups) + group
            many = np.bincount(key)[key] >= COMBINED_ROWS
            few = pa.array(np.flatnonzero(~many))
            alone = [batch.column(c).take(few) for c in ("gene_id", "group", "umi", "bits")]
            rows = np.flatnonzero(many)
            keys, sums = _grouped_sums(key[rows], umi[rows], batch.column("bits").take(pa.array(rows)), plan)
            first = {k: r for r, k in zip(rows[::-1].tolist(), key[rows][::-1].tolist(), strict=True)}
            at = [first[k] for k in keys.tolist()]
            whole = np.bincount(key[rows], umi[rows])[keys].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            none = pa.nulls(len(few), pa.binary())
            yield pa.RecordBatch.from_arrays([*alone, none], names=["gene_id", "group", "umi", "bits", "sums"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gene[at], pa.int64()), pa.array(group[at], pa.int32()), pa.array(whole), pa.nulls(len(at), pa.binary()),
                 pa.array([s.tobytes() for s in sums], pa.binary())],
                names=["gene_id", "group", "umi", "bits", "sums"],
            )

    return run


def _winners(cpm: np.ndarray) -> np.ndarray:
    """Index of the one type with the greatest mean over donors of log1p, -1 where none is positive, -2 for ties.

    The last axes of ``cpm``, which this overwrites, are donors, types and draws. Means of logarithms are in the order of the products
    of what they are taken of, so none is taken as long as the products stay finite.
    """
    donors = cpm.shape[-3]
    if donors <= MOST_FACTORS:
        cpm += 1
        scores = np.multiply.reduce(cpm, axis=-3)
        best = scores.max(axis=-2)
        near, none = scores >= (best * np.exp(-TIE * donors))[..., None, :], best <= 1
    else:
        scores = np.log1p(cpm, out=cpm).sum(axis=-3) / donors
        best = scores.max(axis=-2)
        near, none = best[..., None, :] - scores <= TIE, best <= 0
    return np.where(none, -1, np.where(near.sum(axis=-2) > 1, -2, near.argmax(axis=-2)))


class _Counts:
    """The counts of some genes, from which scores are made for one scenario and a run of draws at a time."""

    def __init__(self, plan: Plan, library: np.ndarray, genes: list[int], owner: np.ndarray, batch: pa.Table, binomials: Binomials) -> None:
        self.plan, self.library, self.binomials = plan, library, binomials
        self.genes, n_groups = np.array(genes, object), len(plan.groups)
        self.labels, self.labelled = np.zeros((len(genes), n_groups), _U), np.zeros(len(genes), bool)
        marked = batch.column("marker").to_numpy(zero_copy_only=False).astype(bool)
        place = owner * n_groups + batch.column("group").to_numpy()
        umi = batch.column("umi").to_numpy()
        self.whole = np.bincount(place[~marked], umi[~marked], len(genes) * n_groups).astype(np.int64)
        bits, vectors = batch.column("bits").combine_chunks(), batch.column("sums").combine_chunks()
        single = np.flatnonzero(~marked & np.asarray(bits.is_valid()))
        single = single[np.argsort(place[single], kind="stable")]
        self.place, self.umi = place[single], umi[single]
        self.packed = np.frombuffer(b"".join(bits.take(pa.array(single)).to_pylist()), np.uint8).reshape(len(single), len(plan.sampled), plan.bytes)
        self.vectors = [
            (int(place[r]), np.frombuffer(vectors[r].as_py(), np.int64).reshape(len(plan.sampled), plan.reps))
            for r in np.flatnonzero(np.asarray(vectors.is_valid())).tolist()
        ]

    def _sampled(self, s: int, some: np.ndarray, groups: np.ndarray, lo: int, hi: int) -> np.ndarray:
        n_groups = len(self.plan.groups)
        at, column = np.full(len(self.genes), -1), np.full(n_groups, -1)
        at[some], column[groups] = np.arange(len(some)), np.arange(len(groups))
        out = np.zeros((len(some) * len(groups), hi - lo))
        to = lambda place: at[place // n_groups] * len(groups) + column[place % n_groups]
        rows = self._drawn_rows(s, at, lo, hi)
        for first in range(0, len(rows), ROWS_AT_ONCE):
            block = rows[first : first + ROWS_AT_ONCE]
            own = to(self.place[block])
            draws = np.unpackbits(self.packed[block, s, lo // 8 : -(-hi // 8)], axis=1, count=hi - lo)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sums = draws * self.umi[block].astype(float)[:, None]
            out[own[starts]] += np.add.reduceat(sums, starts, axis=0) if len(starts) < len(block) else sums
        for place, sums in self.vectors:
            if at[place // n_groups] >= 0 and column[place % n_groups] >= 0:
                out[to(place)] += sums[s, lo:hi]
        return out

    def _drawn_rows(self, s: int, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Rows of the genes that have a place in ``at`` and of cells in any of the draws."""
        wanted = at[self.place // len(self.plan.groups)] >= 0
        return np.flatnonzero(wanted & self.packed[:, s, lo // 8 : -(-hi // 8)].any(axis=1))

    def _few(self, s: int, some: np.ndarray, lo: int, hi: int) -> np.ndarray | None:
        """:meth:`winners` of a sampled scenario where few draws hold a gene: only those are scored. None where they are many."""
        plan, n_groups = self.plan, len(self.plan.groups)
        at = np.full(len(self.genes), -1)
        at[some] = np.arange(len(some))
        rows = self._drawn_rows(s, at, lo, hi)
        packed = self.packed[rows, s, lo // 8 : -(-hi // 8)]
        if self.vectors or np.bitwise_count(packed).sum(dtype=np.int64) * SPARSE > len(some) * n_groups * (hi - lo):
            return None
        won = np.full(len(some) * (hi - lo), -1)
        row, draw = np.nonzero(np.unpackbits(packed, axis=1, count=hi - lo))
        place = self.place[rows[row]]
        column, which = np.unique(at[place // n_groups] * (hi - lo) + draw, return_inverse=True)
        sums = np.bincount(which * n_groups + place % n_groups, self.umi[rows[row]], len(column) * n_groups).reshape(-1, n_groups)
        sums = sums * self.library[:, s, lo:hi].T[column % (hi - lo)]
        own = [plan.types.index(t) for t in plan.sampled[s].types]
        cpm = sums.reshape(len(column), len(plan.donors), len(plan.types))[:, :, own]
        won[column] = _winners(np.moveaxis(cpm, 0, 2))
        return won.reshape(len(some), hi - lo)

    def _thinned(self, scenario: Scenario, some: np.ndarray, groups: np.ndarray, lo: int, hi: int) -> np.ndarray:
        whole = self.whole.reshape(-1, len(self.plan.groups))[some][:, groups].ravel()
        out = np.zeros((len(whole), hi - lo))
        seen = np.flatnonzero(whole)
        seen = seen[np.argsort(whole[seen], kind="stable")]
        labels = self._labels(some).reshape(len(some), -1)[:, groups].ravel()
        out[seen] = thinned_once(whole[seen], labels[seen], self.plan, scenario, self.binomials, lo, hi)
        return out

    def _labels(self, some: np.ndarray) -> np.ndarray:
        """Labels of the genes' groups, made for a group with counts when first asked for."""
        whole = self.whole.reshape(-1, len(self.plan.groups))
        for i in some[~self.labelled[some]].tolist():
            for j in np.flatnonzero(whole[i]).tolist():
                self.labels[i, j] = word(self.plan.seed, *self.plan.groups[j], self.genes[i])
        self.labelled[some] = True
        return self.labels[some].ravel()

    def winners(self, s: int, some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Per gene of ``some`` and draw from ``lo``, a multiple of 8, to ``hi``: see :func:`_winners`; types as the scenario lists them."""
        plan = self.plan
        scenario = [*plan.sampled, *plan.thinned][s]
        if s < len(plan.sampled):
            few = self._few(s, some, lo, hi)
            if few is not None:
                return few
        place = {g: i for i, g in enumerate(plan.groups)}
        groups = np.array([place[d, t] for d in plan.donors for t in scenario.types])
        out = np.empty((len(some), hi - lo), np.int64)
        for first in range(0, len(some), GENES_SCORED):
            part = some[first : first + GENES_SCORED]
            cpm = self._sampled(s, part, groups, lo, hi) if s < len(plan.sampled) else self._thinned(scenario, part, groups, lo, hi)
            cpm = cpm.reshape(len(part), len(groups), hi - lo)
            cpm *= self.library[groups, s, lo:hi]
            out[first : first + GENES_SCORED] = _winners(cpm.reshape(len(part), len(plan.donors), len(scenario.types), hi - lo))
        return out


def _streamed(plan: Plan, totals: np.ndarray, thin_totals: np.ndarray, told: Callable[[_Counts, pa.Table], pa.RecordBatch]):
    """Streams rows sorted by gene: ``told`` gets the counts and the marker rows of some genes at a time."""
    whole_library = np.concatenate([totals, thin_totals], axis=1)
    library = np.where(whole_library > 0, 1e6 / np.maximum(whole_library, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binomials = Binomials()
        rest: pa.Table | None = None

        def done(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            gene = table.column("gene_id").to_numpy()
            starts = np.flatnonzero(np.diff(gene, prepend=gene[0] - 1))
            whole = starts if last else starts[:-1]
            for i in range(0, len(whole), GENES_AT_ONCE):
                some = whole[i : i + GENES_AT_ONCE]
                j = i + len(some)
                hi = starts[j] if j < len(starts) else len(gene)
                part = table.slice(some[0], hi - some[0])
                owner = np.repeat(np.arange(len(some)), np.diff([*some, hi]))
                yield told(_Counts(plan, library, gene[some].tolist(), owner, part, binomials), part.filter(part.column("marker")))
            if not last:
                yield table.slice(starts[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if table.num_rows:
                *ready, rest = done(table, False)
                yield from ready
        if rest is not None and rest.num_rows:
            yield from done(rest, True)

    return run


def _tallied(plan: Plan):
    """One row of tallies for each gene and scenario."""

    def tally(counts: _Counts, markers: pa.Table) -> pa.RecordBatch:
        every = np.arange(len(counts.genes))
        rows = []
        for s, scenario in enumerate([*plan.sampled, *plan.thinned]):
            won = counts.winners(s, every, 0, plan.reps)
            wins = np.stack([(won == k).sum(axis=1) for k in range(len(scenario.types))], axis=1)
            zero, tie = (won == -1).sum(axis=1), (won == -2).sum(axis=1)
            rows += [(g, scenario.name, z, t, w) for g, z, t, w in zip(counts.genes, zero.tolist(), tie.tolist(), wins.tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["gene_id", "scenario", "zero", "tie", "wins"])

    return tally


def _least(plan: Plan, held_out: str):
    """One row for each gene: the fewest draws that its baseline type wins in any scenario but ``held_out``, and those it wins in that one.

    Once a scenario has as many wins as the fewest of another it cannot lower them, so its other draws are not scored; scenarios
    with the fewest wins, those of a few cells, come first.
    """
    scenarios = [*plan.sampled, *plan.thinned]
    order = sorted(range(len(scenarios)), key=lambda s: (scenarios[s].operation != CELL_N, scenarios[s].operation == UMI_FRACTION, scenarios[s].parameter))

    def tally(counts: _Counts, markers: pa.Table) -> pa.RecordBatch:
        n = len(counts.genes)
        at = {g: i for i, g in enumerate(counts.genes)}
        top: dict[tuple[str, ...], np.ndarray] = {s.types: np.full(n, -1) for s in scenarios}
        for g, tops in zip(markers.column("gene_id").to_pylist(), markers.column("tops").to_pylist(), strict=True):
            for types, t in tops:
                if tuple(types.split(";")) in top:
                    top[tuple(types.split(";"))][at[g]] = types.split(";").index(t)
        least, held = np.full(n, plan.reps + 1), np.full(n, -1)
        for s in order:
            own, apart = top[scenarios[s].types], scenarios[s].name == held_out
            open_ = np.flatnonzero(own >= 0)
            if not apart:
                open_ = open_[least[open_] > 0]
            wins = np.zeros(n, np.int64)
            step = plan.reps if apart or (least > plan.reps).all() else SCORED_AT_ONCE
            for lo in range(0, plan.reps, step):
                if not len(open_):
                    break
                won = counts.winners(s, open_, lo, min(plan.reps, lo + step))
                wins[open_] += (won == own[open_][:, None]).sum(axis=1)
                if not apart:
                    open_ = open_[wins[open_] < least[open_]]
            if apart:
                held[open_] = wins[open_]
            else:
                least[open_] = wins[open_]
        cols = [pa.array(counts.genes.tolist(), pa.int64()), pa.array(least, pa.int64(), mask=least > plan.reps), pa.array(held, pa.int64(), mask=held < 0)]
        return pa.RecordBatch.from_arrays(cols, names=["gene_id", "least", "held"])

    return tally


def _gene_rows(cells: DataFrame, counts: DataFrame, genes: DataFrame, plan: Plan) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows sorted by gene, of which one marks each gene and carries its ``tops``; and the library totals of all draws."""
    bits = cut_lineage(cell_bits(cells, plan))
    totals = library_totals(bits, plan)
    wanted = counts.join(genes.select("gene_id"), "gene_id", "left_semi").filter("umi > 0")
    met = wanted.join(bits.select("cell_id", "group", "bits"), "cell_id")
    fields = "gene_id long, group int, umi long, bits binary, sums binary"
    rows = met.select(F.col("gene_id").cast("long"), "group", F.col("umi").cast("long"), "bits").mapInArrow(_combined(plan), fields)
    if plan.thinned:
        placed = cells.select("cell_id", "donor", "cell_type", "total").filter(plan.group(F.col("donor"), F.col("cell_type")).isNotNull())
        sums = wanted.join(placed, "cell_id").groupBy("gene_id", "donor", "cell_type").agg(F.sum("umi").alias("umi"))
        thin_totals = thinned_totals(sums, placed.groupBy("donor", "cell_type").agg(F.sum("total").alias("total")), plan)
    else:
        thin_totals = np.zeros((len(plan.groups), 0, plan.reps), np.int64)
    marker = genes.select(
        F.col("gene_id").cast("long"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("umi"), F.lit(None).cast("binary").alias("bits"),
        F.lit(None).cast("binary").alias("sums"), F.lit(True).alias("marker"), "tops",
    )
    every = rows.withColumns({"marker": F.lit(False), "tops": F.lit(None).cast(TOPS)}).unionByName(marker)
    return _by_key(every, ["gene_id"]), totals, thin_totals


def tallies(cells: DataFrame, counts: DataFrame, genes: DataFrame, table: DataFrame, scenarios: Sequence[Scenario], donors: Sequence[str],
            reps: int, seed: int) -> DataFrame:
    """Per gene of ``genes`` and scenario that can be drawn: draws without counts, draws with a tie, and ``wins`` of the scenario's types.

    ``cells`` has cell_id, donor, cell_type and total; ``counts`` has cell_id, gene_id (a number) and umi, of which each
    pair stands once; ``table`` is their :func:`design`. Scores are equal-donor means of log1p CPM; the drawn
    library is the denominator, and a gene without counts in a drawn library scores zero there.
    """
    plan = Plan(table, scenarios, donors, reps, seed)
    rows, totals, thin_totals = _gene_rows(cells, counts, genes.withColumn("tops", F.lit(None).cast(TOPS)), plan)
    return rows.mapInArrow(_streamed(plan, totals, thin_totals, _tallied(plan)), "gene_id long, scenario string, zero long, tie long, wins array<long>")


def least_agreement(cells: DataFrame, counts: DataFrame, genes: DataFrame, baselines: DataFrame, table: DataFrame, scenarios: Sequence[Scenario],
                    donors: Sequence[str], reps: int, seed: int, held_out: str) -> DataFrame:
    """Per gene the worst agreement with its baseline over all scenarios but one, and that of the one, without all of :func:`tallies`.

    ``baselines`` is that of :func:`stability`; the result is what the tallies of all draws give, null without a baseline or scenario.
    """
    plan = Plan(table, scenarios, donors, reps, seed)
    known = baselines.filter(F.col("baseline_top_type").isNotNull())
    tops = known.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("comparison_types", "baseline_top_type"))).alias("tops"))
    marked = genes.select("gene_id").join(tops, "gene_id", "left").withColumn("tops", F.coalesce("tops", F.create_map().cast(TOPS)))
    rows, totals, thin_totals = _gene_rows(cells, counts, marked, plan)
    told = rows.mapInArrow(_streamed(plan, totals, thin_totals, _least(plan, held_out)), "gene_id long, least long, held long")
    n = F.lit(float(reps))
    # without any scenario there is no gene to tell of
    told = told if plan.scenarios else told.limit(0)
    return told.select("gene_id", (F.col("least") / n).alias("min_agreement"), (F.col("held") / n).alias("held_out_agreement"))


def stability(tallied: DataFrame, baselines: DataFrame, scenarios: Sequence[Scenario], types: Sequence[str], reps: int) -> DataFrame:
    """Fractions of draws from :func:`tallies` beside the winner without sampling.

    ``baselines`` has gene_id, comparison_types and baseline_top_type; agreement is null for a gene without one.
    The modal type is the first of those that won most often; ``top_fraction_i`` is that of the i-th of ``types``, null
    in a scenario without it.
    """
    sets = F.create_map(*[x for s in scenarios for x in (F.lit(s.name), F.array(*map(F.lit, s.types)))])
    n = F.lit(float(reps))
    rows = tallied.withColumn("_types", sets[F.col("scenario")]).withColumn("comparison_types", F.array_join("_types", ";"))
    joined = rows.join(baselines, ["gene_id", "comparison_types"], "left")
    wins_of = lambda t: F.get("wins", (F.array_position("_types", t) - 1).cast("int"))
    won = lambda t: F.when(F.array_contains("_types", t), wins_of(t))
    best = F.array_max("wins")
    valid = F.aggregate("wins", F.lit(0).cast("long"), lambda a, x: a + x)
    return joined.select(
        "gene_id", "scenario", "comparison_types", F.lit(reps).cast("long").alias("n_draws"), valid.alias("valid_draws"), "baseline_top_type",
        (wins_of(F.col("baseline_top_type")) / n).alias("baseline_agreement"),
        F.when(best > 0, F.get("_types", (F.array_position("wins", best) - 1).cast("int"))).alias("modal_type"),
        (best / n).alias("modal_fraction"), (F.col("zero") / n).alias("zero_fraction"), (F.col("tie") / n).alias("tie_fraction"),
        *[(won(F.lit(t)) / n).alias(f"top_fraction_{i}") for i, t in enumerate(types)],
    )
