"""Adaptive context-mixing range coder for blocks of token ids, many blocks side by side.

Every block starts from the same empty model and is coded by itself; blocks are only advanced together,
one id of each per step, so that NumPy works on whole vectors. For each id the model has

* an order-2 and an order-1 prediction, the id last confirmed after the two ids or the one id before, each
  with a confidence from 0 to 7;
* mixing probabilities, one pair for each combination of confidences, that learn how often either
  prediction is right and so share out the interval between them and the rest;
* an order-0 distribution over ranges of 16 ids for the rest, renewed from the counts of all ids so far
  at fixed steps of the block.

An id is one part of an interval of 2^30: 2^12 for the mixture times 2^18 for the order-0 distribution.
The encoder knows all ids, so contexts and order-0 shares are made for whole blocks, and only the tables and
the interval go step by step. Its low end may carry into words already out; carries are settled at the end.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
"""Ids in a block, the last one of a record may have fewer."""

LANES = 2048
"""Blocks coded side by side, which bounds memory."""

RENEWED = 32
"""Blocks whose order-0 distributions are renewed together, as many as a processor's cache holds."""

RENEWALS = (32, 96, 256, 640, 1280, 2432)
"""Steps of a block before which its order-0 distribution is renewed."""

CHUNK = 32
"""Steps whose contexts and intervals the encoder makes at once."""

SLOTS1, SLOTS2 = 2048, 4096
SLOTS = SLOTS1 + SLOTS2
SPAN = 16
BUCKETS = 65536 // SPAN
SCALE = 1 << 14
MOST = 4088
REST_BITS, ALL_BITS = 18, 30
U = np.uint64
SIXTEEN = U(16)


class _Numbers(dict):
    """Numbers of one type as arrays without dimensions, which a step of many vectors takes faster than scalars."""

    def __init__(self, kind: type) -> None:
        self.kind = kind

    def __missing__(self, value: int) -> np.ndarray:
        self[value] = np.array(value, self.kind)
        return self[value]


U16, U32, U64 = _Numbers(np.uint16), _Numbers(np.uint32), _Numbers(U)
I16, I32 = _Numbers(np.int16), _Numbers(np.int32)
LOW = U64[(1 << 40) - 1]
FLOOR = U64[1 << 40]


class _Model:
    """The order-0 models of some blocks; all arrays have a row for each."""

    def __init__(self, lanes: int, inverse: bool) -> None:
        self.counts = np.zeros((lanes, BUCKETS), np.int16)  # at most BLOCK
        self.cum = np.empty((lanes, BUCKETS + 1), np.int16)  # at most SCALE
        self.inverse = np.empty((lanes, SCALE), np.int16) if inverse else None
        self.renew(min(lanes, 1))  # without counts all are alike
        self.cum[1:] = self.cum[:1]
        if inverse:
            self.inverse[1:] = self.inverse[:1]

    def count(self, ids: np.ndarray) -> None:
        """Counts some more ids of the first blocks, a row for each."""
        for at in range(0, len(ids), RENEWED):
            some = ids[at : at + RENEWED]
            cells = (some // np.uint16(SPAN)).astype(np.int64) + np.arange(len(some))[:, None] * BUCKETS
            found = np.bincount(cells.ravel(), minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
            self.counts[at : at + len(some)] += found.astype(np.int16)

    def renew(self, k: int) -> None:
        """Order-0 distribution of the first k blocks from their counts; every range keeps a share."""
        floors = np.arange(1, BUCKETS + 1, dtype=np.uint32)
        ranges = np.tile(np.arange(BUCKETS, dtype=np.int16), min(k, RENEWED))
        at = 0
        while at < k:
            to = min(k, at + RENEWED)
            sums = self.counts[at:to].astype(np.uint32)
            np.cumsum(sums, axis=1, out=sums)  # at most BLOCK, so the products fit
            totals = np.maximum(sums[:, -1], 1).tolist()
            sums *= np.uint32(SCALE - BUCKETS)
            for row, total in zip(sums, totals, strict=True):
                np.floor_divide(row, np.uint32(total), out=row)  # one divisor at a time is several times faster
            sums += floors
            sums[:, -1] = SCALE
            cum = self.cum[at:to]
            cum[:, 0] = 0
            cum[:, 1:] = sums
            if self.inverse is not None:
                sums[:, 1:] -= cum[:, 1:-1].view(np.uint16)
                widths = sums.ravel().astype(np.int64)
                self.inverse[at:to] = np.repeat(ranges[: len(widths)], widths).reshape(to - at, SCALE)
            at = to


class _Tables:
    """Order-1 and order-2 predictions of the first k of some blocks, with their mixing probabilities.

    An entry is an id and, above its 16 bits, a confidence. A share packs the parts of 4096 of both orders, that of
    order 2 above, for each pair of confidences and whether both predict the same id; the two sum to ``MOST`` at most.
    """

    def __init__(self, lanes: int) -> None:
        self.table = np.empty(lanes * SLOTS, np.uint32)
        self.table[:] = 0  # memory of its own at once, in large pages where there are any
        order2 = np.arange(128, dtype=np.int32) // 16 * 480 + 200
        order1 = (np.arange(128, dtype=np.int32) // 2 % 8 * 400 + 200) * (MOST - order2) // 4096
        self.shares = np.tile(order2 << 16 | order1, lanes)
        self.all_first = np.arange(lanes, dtype=np.int64) * SLOTS
        self.all_cells = np.arange(lanes, dtype=np.int64) * 128
        self.resize(lanes)

    def resize(self, k: int) -> None:
        self.k = k
        self.first, self.first2, self.first_cell = self.all_first[:k], self.all_first[:k] + SLOTS1, self.all_cells[:k]
        self.entry, self.sure, self.half, self.kept = (np.empty((2, k), np.uint32) for _ in range(4))
        self.part, self.cell = np.empty(k, np.uint32), np.empty(k, np.int64)

    def slots(self, before: np.ndarray, second: np.ndarray, out: np.ndarray) -> None:
        """Places in the table of the contexts ``before`` and (``second``, ``before``), whose products may wrap."""
        mixed = before * U16[40503]
        np.add(self.first, mixed // U16[65536 // SLOTS1], out=out[..., 0, :])
        mixed += second * U16[60493]
        mixed //= U16[65536 // SLOTS2]
        np.add(self.first2, mixed, out=out[..., 1, :])

    def entries(self, places: np.ndarray) -> np.ndarray:
        return np.take(self.table, places, out=self.entry, mode="wrap")

    def look(self, entry: np.ndarray, agree: np.ndarray) -> np.ndarray:
        """The shares for the confidences of the entries and whether both orders agree."""
        sure, part = self.sure, self.part
        np.right_shift(entry, U32[16], out=sure)
        np.multiply(sure[1], U32[8], out=part)
        part += sure[0]
        part += part
        part += agree
        np.add(self.first_cell, part, out=self.cell)
        return np.take(self.shares, self.cell, mode="wrap")

    def learn(self, places: np.ndarray, ids: np.ndarray, wrong: np.ndarray, right: np.ndarray, shares: np.ndarray) -> None:
        """``wrong``: predictions xor ids, which is spent; ``right``: whether that is zero; the rest as in ``look``."""
        goal = right[1].astype(np.int32)
        goal *= I32[MOST << 16]
        only1 = np.greater(right[0], right[1]).astype(np.int32)
        only1 *= I32[MOST]
        goal += only1
        step, packed = goal.view(np.int16), shares.view(np.int16)
        step -= packed
        step //= I16[16]
        step += packed
        self.shares[self.cell] = goal
        sure, half, kept = self.sure, self.half, self.kept
        np.floor_divide(sure, U32[2], out=half)
        np.minimum(half, U32[1], out=kept)
        wrong *= kept  # an id of little confidence is replaced
        wrong ^= ids
        np.maximum(half, U32[1], out=half)
        sure += U32[1]
        np.minimum(sure, U32[7], out=sure)
        sure -= half
        sure *= right.astype(np.uint32)
        sure += half
        sure *= U32[65536]
        sure |= wrong
        self.table[places.ravel()] = sure.ravel()


def _order(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks by falling length, and how many are still active at each step."""
    sizes = np.asarray(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), side="right")
    return order, active


def _runs(n: int) -> list[tuple[int, int]]:
    """As few runs of at most ``LANES`` blocks as there can be, of even length: a short run takes as many steps as a long one."""
    parts = -(-n // LANES)
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block of ids below 65,536."""
    out: list[bytes] = []
    for at, to in _runs(len(blocks)):
        out += _encode(blocks[at:to])
    return out


def _rest(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and share of each id in the order-0 distribution of its block and step; blocks are rows."""
    start, share = np.empty(ids.shape, np.uint32), np.empty(ids.shape, np.uint16)
    steps = ids.shape[1]
    marks = [0, *(m for m in RENEWALS if m < steps), steps]
    for at in range(0, len(ids), RENEWED):
        some = ids[at : at + RENEWED]
        model = _Model(len(some), False)
        flat, rows = model.cum.ravel(), np.arange(len(some))[:, None] * (BUCKETS + 1)
        for lo, hi in zip(marks[:-1], marks[1:], strict=True):
            now = some[:, lo:hi]
            cell = rows + now // np.uint16(SPAN)
            c = flat[cell].astype(np.uint32)
            f = flat[cell + 1].astype(np.uint32) - c
            share[at : at + RENEWED, lo:hi] = f
            c *= np.uint32(SPAN)
            c += (now & np.uint16(SPAN - 1)) * f
            start[at : at + RENEWED, lo:hi] = c
            if hi < steps:
                model.count(now)
                model.renew(len(some))
    return start, share


def _carried(words: np.ndarray) -> np.ndarray:
    """Words of 16 bits after carries into those before them, rows apart."""
    while True:
        carry = words >> np.uint32(16)
        if not carry.any():
            return words.astype(">u2")
        words &= np.uint32(65535)
        words[:, :-1] += carry[:, 1:]


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    n = len(blocks)
    order, active = _order([len(b) for b in blocks])
    steps = len(active)
    ids = np.zeros((n, steps + 2), np.uint16)  # with two zeros before
    for to, i in enumerate(order):
        ids[to, 2 : 2 + len(blocks[i])] = blocks[i]
    rest_start, rest_share = _rest(ids[:, 2:])
    tables = _Tables(n)
    low, span = np.zeros(n, U), np.full(n, (1 << 56) - 1, U)
    width = steps * 15 // 8 + steps // 50 + 8
    words = np.zeros(n * width, np.uint32)
    place = np.arange(n, dtype=np.int64) * width
    first = place.copy()
    for at in range(0, steps, CHUNK):
        k, size = int(active[at]), min(CHUNK, steps - at)
        if k != tables.k:
            tables.resize(k)
        near = np.ascontiguousarray(ids[:k, at : at + size + 2].T)
        places = np.empty((size, 2, k), np.int64)
        tables.slots(near[1:-1], near[:-2], places)
        near = near[2:].astype(np.uint32)
        shares, right = np.empty((size, k), np.int32), np.empty((size, 2, k), bool)
        for j in range(size):
            entry = tables.entries(places[j])
            old = entry ^ near[j]
            old &= U32[65535]
            np.equal(old, U32[0], out=right[j])
            shares[j] = tables.look(entry, old[0] == old[1])
            tables.learn(places[j], near[j], old, right[j], shares[j])
        f2 = ((shares >> np.int32(16)) + np.int32(1)).astype(U)
        f1 = ((shares & np.int32(65535)) + np.int32(1)).astype(U)
        not2 = (~right[:, 1]).astype(U)
        miss = not2 * ~right[:, 0]
        others = U(4096) - f2 - f1
        f2 <<= U(REST_BITS)
        f1 <<= U(REST_BITS)
        start = not2 * f2 + miss * (f1 + others * rest_start[:k, at : at + size].T)
        freq = f2 + not2 * (f1 - f2) + miss * (others * rest_share[:k, at : at + size].T - f1)  # may wrap in between
        for j in range(size):
            k = int(active[at + j])
            lo, r, p = low[:k], span[:k], place[:k]
            r >>= U64[ALL_BITS]
            lo += r * start[j, :k]
            r *= freq[j, :k]
            words[p] = lo >> U64[40]
            out = (r < FLOOR).astype(U)
            p += out.view(np.int64)
            lo &= (out - U64[1]) | LOW
            out <<= U64[4]
            lo <<= out
            r <<= out
            (more,) = (r < FLOOR).nonzero()
            if len(more):
                words[place[more]] = low[more] >> U64[40]
                place[more] += 1
                low[more] = (low[more] & LOW) << SIXTEEN
                span[more] <<= SIXTEEN
    low += U((1 << 24) - 1)  # a number within the interval whose later bits may be any
    for _ in range(2):
        words[place] = low >> U(40)
        place += 1
        low = (low & LOW) << SIXTEEN
    used = (place - first).tolist()
    table = words.reshape(n, width)
    out = [b""] * n
    for at in range(0, n, RENEWED):
        some = _carried(table[at : at + RENEWED, : max(used[at : at + RENEWED])])
        for row, length, i in zip(some, used[at : at + RENEWED], order[at : at + RENEWED], strict=True):
            out[i] = row[:length].tobytes()
    return out


def decode(coded: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """The ids of blocks given as (number of ids, bytes)."""
    out: list[np.ndarray] = []
    for at, to in _runs(len(coded)):
        out += _decode(coded[at:to])
    return out


def _decode(coded: list[tuple[int, bytes]]) -> list[np.ndarray]:
    n = len(coded)
    order, active = _order([c[0] for c in coded])
    steps = len(active)
    place = np.cumsum([0] + [len(coded[i][1]) for i in order[:-1]], dtype=np.int64)
    data = np.frombuffer(b"".join(coded[i][1] for i in order) + bytes(16), np.uint8)
    pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    code, span = np.zeros(n, U), np.full(n, (1 << 56) - 1, U)
    for j in range(7):
        code = code << U(8) | data[place + j].astype(U)
    place += 7
    tables, model = _Tables(n), _Model(n, True)
    cum, inverse = model.cum.ravel(), model.inverse.ravel()
    rows_cum, rows_inverse = np.arange(n, dtype=np.int64) * (BUCKETS + 1), np.arange(n, dtype=np.int64) * SCALE
    ids = np.zeros((steps + 2, n), np.uint16)  # with two zeros before
    places, counted = np.empty((2, n), np.int64), 0
    for i in range(steps):
        k = int(active[i])
        if k != tables.k:
            tables.resize(k)
            places = np.empty((2, k), np.int64)
        if i in RENEWALS:
            model.count(ids[2 + counted : 2 + i, :k].T)
            model.renew(k)
            counted = i
        tables.slots(ids[i + 1, :k], ids[i, :k], places)
        entry = tables.entries(places)
        old = entry & U32[65535]
        shares = tables.look(entry, old[0] == old[1])
        f2 = shares >> I32[16]
        f2 += I32[1]
        both = shares & I32[65535]
        both += f2
        both += I32[1]
        now, r, p = code[:k], span[:k], place[:k]
        r >>= U64[ALL_BITS]
        others = r * (I32[4096] - both).astype(U)
        r *= U64[1 << REST_BITS]
        end2, end1 = r * f2.astype(U), r * both.astype(U)
        not2, miss = now >= end2, now >= end1
        v = now - end1
        v //= others
        np.minimum(v, U64[(1 << REST_BITS) - 1], out=v)  # of those that are no miss
        v = v.astype(np.int32)
        bucket = inverse.take(rows_inverse[:k] + v // I32[SPAN], mode="wrap")
        cell = rows_cum[:k] + bucket
        c = cum.take(cell, mode="wrap").astype(np.int32)
        cell += 1
        f = cum.take(cell, mode="wrap") - c
        c *= I32[SPAN]
        v -= c
        v //= f
        c += v * f
        v += bucket * I32[SPAN]
        x = old[0] - old[1]  # this and what follows may wrap in between
        x *= not2.astype(np.uint32)
        x += old[1]
        v = v.view(np.uint32)
        v -= x
        v *= miss.astype(np.uint32)
        x += v
        not2, missed = not2.astype(U), miss.astype(U)
        end1 -= end2
        now -= not2 * end2
        now -= missed * (end1 + others * c.astype(U))
        others *= f.astype(U)
        others -= end1
        others *= missed
        end1 -= end2
        end1 *= not2
        end1 += end2
        np.add(end1, others, out=r)
        out = (r < FLOOR).astype(U)
        word = out * pairs.take(p, mode="wrap")
        out *= U64[2]
        p += out.view(np.int64)
        out *= U64[8]
        now <<= out
        now |= word
        r <<= out
        (more,) = (r < FLOOR).nonzero()
        if len(more):
            q = place[more]
            code[more] = code[more] << SIXTEEN | pairs[q]
            place[more] = q + 2
            span[more] <<= SIXTEEN
        ids[i + 2, :k] = x
        old ^= x
        tables.learn(places, x, old, old == 0, shares)
    found = np.ascontiguousarray(ids[2:].T)
    out = [np.zeros(0, np.uint16)] * n
    for to, i in enumerate(order):
        out[i] = found[to, : coded[i][0]].copy()
    return out
