"""Best-fit packing of token sequences by bin completion with branch and bound.

Sequences are completed one after the other: the largest length left opens one and takes a filling. A first solution takes
the best filling each time. Where it needs more sequences than a lower bound allows, a search goes back over the
sequences: around each largest length it branches on the undominated fillings, a branch ends once the room wasted so far
would cost a sequence against the best solution yet, and the search ends at the lower bound or with its nodes.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.tokens import encoder
from corrobora.session import cut_lineage

SHARD_PIECES = 20_000
"""Pieces packed together by one task; a table has as many shards as it needs."""

SEARCH_NODES = 64
"""Lengths tried for a sequence after its best-fit filling, before the best one found so far is taken."""

FIRST_NODES, RESTARTS, RESTART_NODES = 4000, 40, 400
"""Sequences opened by a shard's search over solutions before its best one is taken: fullest fillings first, and then in
restarts, each with fillings that leave the same room in another order."""

MOST_KINDS = 40
"""Different lengths up to which pairs of a filling are tested for dominance."""

FILLINGS = 24
"""Undominated fillings tried for a sequence, fullest first."""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, spaced: bool, end_id: int, capacity: int) -> DataFrame:
    """Per piece of each row: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; only what is longer than ``capacity`` is cut, into pieces of
    that length and a last one that may be shorter. A null text is empty and has the end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced).encode_one
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                total = len(ids) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for to, x in zip(rows, (doc_id, k, at, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class _Shelf:
    """Counts of the lengths left, with bit sets of the lengths there are: ``up`` has bit L, ``down`` bit capacity - L."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.capacity = capacity
        self.count = [0] * (capacity + 1)
        self.up = self.down = self.total = 0
        for x in lengths:
            self.put(x)

    def put(self, x: int) -> None:
        self.count[x] += 1
        self.total += x
        self.up |= 1 << x
        self.down |= 1 << (self.capacity - x)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        self.total -= x
        if not self.count[x]:
            self.up &= ~(1 << x)
            self.down &= ~(1 << (self.capacity - x))

    def largest(self, limit: int) -> int:
        """The greatest length of at most ``limit``, else 0."""
        return (self.up & ((2 << limit) - 1)).bit_length() - 1 if limit > 0 and self.up & ((2 << limit) - 1) else 0

    def least(self) -> int:
        """The smallest length left; only to be asked for if there is one."""
        return (self.up & -self.up).bit_length() - 1 if self.up else self.capacity + 1

    def pairs(self, gap: int, limit: int) -> list[tuple[int, int]]:
        """All pairs of lengths up to ``limit`` that fill the gap exactly, the larger length first."""
        both = self.up & (self.down >> (self.capacity - gap)) & ((1 << gap) - 1) & ~1
        found = []
        while both:
            x = both.bit_length() - 1
            if 2 * x < gap:
                break
            if x <= limit and (2 * x > gap or self.count[x] > 1):
                found.append((x, gap - x))
            both ^= 1 << x
        return found

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths that fill the gap exactly, the larger one as large as can be."""
        both = self.up & (self.down >> (self.capacity - gap)) & ((1 << gap) - 1) & ~1
        while both:
            x = both.bit_length() - 1
            if 2 * x < gap:
                return None
            if 2 * x > gap or self.count[x] > 1:
                return x, gap - x
            both ^= 1 << x
        return None


def _filling(shelf: _Shelf, gap: int) -> list[int]:
    """The best filling of a gap: lengths that leave the least of it.

    Fillings are enumerated from the largest length down, each completed exactly by one or two lengths if
    that is possible. Larger lengths dominate smaller ones in the same place and come first, so the first
    incumbent is the best-fit filling; it is built to the end of the gap, however many pieces that takes.
    ``SEARCH_NODES`` bounds the lengths tried in other places after it. A branch is pruned if all lengths
    left could not bring its waste below the incumbent's; a filling without waste ends the search.
    """
    best: list[int] = []
    best_left = left = limit = gap
    chosen: list[int] = []
    nodes, budget = 0, None
    while True:
        if left <= limit and shelf.count[left]:
            best = [*chosen, left]
            break
        two = shelf.pair(left)
        if two is not None and two[0] <= limit:
            best = [*chosen, *two]
            break
        x = shelf.largest(min(left, limit)) if left - shelf.total < best_left else 0
        spent = budget is not None and nodes >= budget
        if not x or spent:
            if left < best_left:
                best, best_left = list(chosen), left
            budget = SEARCH_NODES
            x = 0
            while chosen and not x and not spent:
                last = chosen.pop()
                shelf.put(last)
                left += last
                x = shelf.largest(last - 1)
            if not x:
                break
        if budget is not None:
            nodes += 1
        shelf.take(x)
        chosen.append(x)
        left, limit = left - x, x
    for x in chosen:
        shelf.put(x)
    return best


def least_sequences(lengths: Sequence[int], capacity: int) -> int:
    """Lower bound: no solution has fewer sequences.

    Beside the total, for every threshold: lengths over its complement share with nothing counted, lengths over a half need a
    sequence each, and what the others leave open must hold the lengths from the threshold to a half.
    """
    if not len(lengths):
        return 0
    x = np.sort(np.asarray(lengths, np.int64))
    sums = np.concatenate([[0], np.cumsum(x)])
    low = np.unique(np.concatenate([[1], x[2 * x <= capacity]]))
    half = np.searchsorted(x, capacity // 2, "right")
    top = np.searchsorted(x, capacity - low, "right")
    start = np.searchsorted(x, low, "left")
    middle, large = top - half, len(x) - top
    rest = sums[half] - sums[np.minimum(start, half)] - (middle * capacity - (sums[top] - sums[half]))
    each = large + middle + np.maximum(0, -(-rest // capacity))
    return int(max(each.max(), -(-sums[-1] // capacity)))


def _dominated(shelf: _Shelf, filling: list[int], slack: int) -> bool:
    """Whether one larger length left over could take the place of one of the filling's, or one length that of two.

    The lengths given back fit wherever the one taken was, so the other filling is never worse. The filling's own lengths are
    off the shelf.
    """

    def between(lo: int, hi: int) -> bool:
        return bool(shelf.up >> lo & ((1 << (hi - lo + 1)) - 1)) if hi >= lo else False

    kinds = sorted(set(filling))
    if any(between(y + 1, y + slack) for y in kinds):
        return True
    pairs = {y + z for i, y in enumerate(kinds) for z in kinds[i + 1 :]} | {2 * y for y in kinds if filling.count(y) > 1}
    return len(kinds) <= MOST_KINDS and any(between(t, t + slack) for t in pairs)


def _fillings(shelf: _Shelf, gap: int, waste: int) -> list[tuple[int, list[int]]]:
    """Undominated fillings of a gap that leave at most ``waste``, as (room left, lengths), fullest first."""
    found: list[tuple[int, list[int]]] = []
    chosen: list[int] = []
    nodes = 0

    def keep(extra: tuple[int, ...], left: int) -> None:
        for x in extra:
            shelf.take(x)
        if not _dominated(shelf, [*chosen, *extra], left):
            found.append((left, [*chosen, *extra]))
        for x in extra:
            shelf.put(x)

    def search(left: int, limit: int) -> None:
        nonlocal nodes
        nodes += 1
        if left <= limit and shelf.count[left]:
            keep((left,), 0)
            return  # one length in this place takes that of any others
        if not shelf.largest(min(left, limit)):
            if left <= waste:
                keep((), left)
            return
        for pair in shelf.pairs(left, limit):
            keep(pair, 0)
        x = shelf.largest(min(left, limit))
        while x and nodes < SEARCH_NODES and len(found) < FILLINGS and left - shelf.total <= waste:
            shelf.take(x)
            chosen.append(x)
            rest = left - x
            # Two lengths that fill exactly have been found; others go on only if room may be left or more can follow.
            if waste or 3 * shelf.least() <= left:
                search(rest, x)
            chosen.pop()
            shelf.put(x)
            x = shelf.largest(x - 1)

    search(gap, gap)
    unique = {tuple(f): left for left, f in found}
    return sorted(((left, list(f)) for f, left in unique.items()), key=lambda r: (r[0], len(r[1]), [-x for x in r[1]]))[:FILLINGS]


def _searched(lengths: list[int], capacity: int, best: list[list[int]], least: int, budget: int, order: random.Random | None) -> list[list[int]]:
    """A solution with fewer sequences than ``best``, if the search finds one by opening ``budget`` sequences."""
    shelf = _Shelf(lengths, capacity)
    total = sum(lengths)
    path: list[tuple[int, list[tuple[int, list[int]]], int]] = []  # first length, fillings, the one in use
    wasted, nodes = 0, 0

    def taken(filling: list[int], put_back: bool) -> None:
        for x in filling:
            (shelf.put if put_back else shelf.take)(x)

    while len(best) > least:
        allowed = (len(best) - 1) * capacity - total - wasted
        options: list[tuple[int, list[int]]] = []
        if not shelf.up:
            best = [[first, *options[i][1]] for first, options, i in path]
        elif nodes < budget:
            nodes += 1
            first = shelf.largest(capacity)
            shelf.take(first)
            options = _fillings(shelf, capacity - first, min(allowed, capacity)) if first < capacity else [(0, [])]
            if order:
                order.shuffle(options)
                options.sort(key=lambda o: o[0])
            if options:
                path.append((first, options, 0))
            else:
                shelf.put(first)
        if options:
            left, filling = options[0]
            taken(filling, False)
            wasted += left
            continue
        while path:  # back to the last sequence that has another filling within the waste allowed
            first, options, i = path.pop()
            taken(options[i][1], True)
            wasted -= options[i][0]
            if nodes < budget and i + 1 < len(options) and options[i + 1][0] <= (len(best) - 1) * capacity - total - wasted:
                path.append((first, options, i + 1))
                taken(options[i + 1][1], False)
                wasted += options[i + 1][0]
                break
            shelf.put(first)
        else:
            break
    return best


def completed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of lengths, each at most ``capacity`` long in all, as few as the search finds."""
    shelf = _Shelf(lengths, capacity)
    out = []
    while shelf.up:
        first = shelf.largest(capacity)
        shelf.take(first)
        rest = _filling(shelf, capacity - first) if first < capacity else []
        for x in rest:
            shelf.take(x)
        out.append([first, *rest])
    least = least_sequences(lengths, capacity)
    out = _searched(lengths, capacity, out, least, FIRST_NODES + len(out), None)
    # A restart that cannot reach the last sequence finds nothing.
    for k in range(RESTARTS if len(out) > least and len(out) < RESTART_NODES else 0):
        out = _searched(lengths, capacity, out, least, RESTART_NODES, random.Random(k))
    return out


def _pack_shard(capacity: int, round_no: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        places: dict[int, list[int]] = {}
        for i, x in enumerate(lengths):
            places.setdefault(x, []).append(i)
        sequence, offset, room = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        base = (round_no << 58) + (key[0].as_py() << 24)
        for n, group in enumerate(completed(lengths, capacity)):
            at, free = 0, capacity - sum(group)
            for x in group:
                i = places[x].pop()
                sequence[i], offset[i], room[i] = base + n, at, free
                at += x
        return (
            table.drop_columns(["shard"])
            .append_column("sequence_id", pa.array(sequence, pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
            .append_column("room", pa.array(room, pa.int64()))
        )

    return run


def packed(docs: DataFrame, path: str, spaced: bool, end_id: int, capacity: int = 4096) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt evenly to shards of about ``SHARD_PIECES``, each packed by one task. The pieces of
    sequences that are not full are then packed again together, until one shard holds them or most of what was
    packed stays loose, so sharding costs hardly a sequence. Every row of ``docs`` is packed, repeated rows
    each for themselves; an empty table gives no sequence.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    left = cut_lineage(pieces(docs, path, spaced, end_id, capacity))
    n, done, round_no = left.count(), [], 0
    while True:
        shards = -(-max(1, n) // SHARD_PIECES)
        dealt = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(shards)).cast("long")
        now = cut_lineage(
            left.withColumn("shard", dealt)
            .groupBy("shard")
            .applyInArrow(_pack_shard(capacity, round_no), PIECES + ", sequence_id long, offset long, room long")
        )
        n_loose = now.filter("room > 0").count()
        if shards == 1 or 2 * n_loose > n:
            done.append(now)
            break
        done.append(now.filter("room = 0"))
        left, n, round_no = now.filter("room > 0").select(*columns), n_loose, round_no + 1
    return reduce(DataFrame.unionByName, done).drop("room")
