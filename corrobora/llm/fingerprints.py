"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph is a piece of the text that ends after a line break, or after a word whose MD5 starts with one of
``CUT_DIGITS``, about one word in eight; so texts without line breaks have paragraphs too, and an edit
moves only those around it. A paragraph's key is 64 bits of the MD5 of its number among equal ones and its bytes: repeats count.

A sketch has three tables of cells; each key is added to one cell of every table, and a cell keeps the number of its keys,
their XOR and the XOR of their check values. Sketches of one width subtract cell by cell: what two
texts share goes, and peeling cells with a single key left recovers all keys that differ. Where that fails both
sketches are made again, four times as wide. A text's fingerprint is its sketch of the first width.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.ranges import with_next

WIDTH = 4
"""Cells of each of the three tables in a fingerprint."""

CUT_DIGITS = "01"
PAIRS_AT_ONCE, CHARS_AT_ONCE = 500, 1 << 22
"""Pairs of texts whose sketches are subtracted and peeled together."""

KNOWN_WORDS = 400_000
"""Words a Python worker remembers; beyond that it starts afresh."""

# Multipliers for the two halves of a key, below 2^31: one pair for each table, one for the check value.
FACTORS = ((2135587861, 1640531527), (1779033703, 1013904223), (1541459225, 2027808485), (1359893119, 1249961773))
_LOW = np.uint64(0xFFFFFFFF)
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")
_ends: dict[bytes, bool] = {}


def _ends_paragraph(token: bytes) -> bool:
    word = token.rstrip(b" \t\n\x0b\x0c\r")
    return b"\n" in token or (bool(word) and hashlib.md5(word).hexdigest()[0] in CUT_DIGITS)


def paragraphs(text: str) -> list[bytes]:
    """Pieces that make up the whole text, in order; an empty text has none."""
    data = text.encode()
    tokens = _TOKEN.findall(data)
    if not tokens:
        return []
    try:
        last = np.fromiter(map(_ends.__getitem__, tokens), bool, len(tokens))
    except KeyError:
        if len(_ends) > KNOWN_WORDS:
            _ends.clear()
        _ends.update((t, _ends_paragraph(t)) for t in set(tokens) if t not in _ends)
        last = np.fromiter(map(_ends.__getitem__, tokens), bool, len(tokens))
    stops = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    last[-1] = True
    cuts = stops[last].tolist()
    return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def keys_of(text: str) -> np.ndarray:
    """Keys of the paragraphs; they are distinct."""
    seen: dict[bytes, int] = {}
    digests = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, 0) + 1
        digests.append(hashlib.md5(b"%d:" % n + p).digest()[:8])
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def _mixed(keys: np.ndarray, k: int) -> np.ndarray:
    a, b = FACTORS[k]
    return (keys & _LOW) * np.uint64(a) + (keys >> np.uint64(32)) * np.uint64(b)


def _checks(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 3) >> np.uint64(16)) & _LOW


@dataclass
class Sketches:
    """Sketches of ``n`` texts, one after the other, each of three tables of ``width`` cells."""

    n: int
    width: int
    counts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    @classmethod
    def of(cls, sets: Sequence[np.ndarray], width: int = WIDTH) -> Sketches:
        size = 3 * width * len(sets)
        out = cls(len(sets), width, np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64))
        if sets:
            keys = np.concatenate(sets)
            out.add(np.repeat(np.arange(len(sets)), list(map(len, sets))), keys, np.ones(len(keys), np.int64))
        return out

    def add(self, owners: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        """Keys to the texts ``owners``, or from them where the sign is -1."""
        checks = _checks(keys)
        for k in range(3):
            at = (_mixed(keys, k) >> np.uint64(24)) % np.uint64(self.width)
            at = at.astype(np.int64) + (3 * owners + k) * self.width
            np.add.at(self.counts, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches(self.n, self.width, self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks)

    def texts(self) -> list[str]:
        """Per sketch the cells, each as 8 hexadecimal digits of the count, 16 of the keys, 8 of the check values."""
        cells = np.empty(len(self.counts), np.dtype([("c", ">u4"), ("k", ">u8"), ("x", ">u4")]))
        cells["c"], cells["k"], cells["x"] = self.counts & 0xFFFFFFFF, self.keys, self.checks
        whole = cells.tobytes().hex()
        size = 96 * self.width
        return [whole[i : i + size] for i in range(0, size * self.n, size)]

    @classmethod
    def parsed(cls, texts: Sequence[str]) -> Sketches:
        """The sketches of fingerprints of one width."""
        cells = np.frombuffer(bytes.fromhex("".join(texts)), np.dtype([("c", ">u4"), ("k", ">u8"), ("x", ">u4")]))
        fields = cells["c"].astype(np.int64), cells["k"].astype(np.uint64), cells["x"].astype(np.uint64)
        return cls(len(texts), len(texts[0]) // 96, *fields)

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owners, keys and signs of all keys found, and which sketches are empty then; the sketches are used up.

        A key is alone in a cell if the count is one either way and the check value is its own. A table
        holds a key once, so the tables take turns and no key is found twice.
        """
        found = []
        active = np.arange(self.n)
        for turn in range(9 * self.width + 3):
            k = turn % 3
            cells = ((3 * active + k)[:, None] * self.width + np.arange(self.width)).ravel()
            cells = cells[np.abs(self.counts[cells]) == 1]
            cells = cells[_checks(self.keys[cells]) == self.checks[cells]]
            owners, keys, signs = cells // (3 * self.width), self.keys[cells], self.counts[cells]
            self.add(owners, keys, -signs)
            found.append((owners, keys, signs))
            if k == 2:
                active = np.intersect1d(active, np.concatenate([f[0] for f in found[-3:]]))
                if not len(active):
                    break
        left = (self.counts != 0) | (self.keys != 0) | (self.checks != 0)
        empty = ~left.reshape(self.n, 3 * self.width).any(axis=1)
        owners, keys, signs = (np.concatenate(x) for x in zip(*found, strict=True))
        return owners, keys, signs, empty


def differences(a: Sequence[np.ndarray], b: Sequence[np.ndarray], first: Sketches) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pair the keys only in ``a`` and only in ``b``, peeled from sketches that widen until it succeeds.

    ``first`` has the differences of the sketches of the first width. Widths at which the numbers of
    keys alone show that peeling cannot succeed are passed over.
    """
    none = np.zeros(0, np.uint64)
    out = [(none, none)] * len(a)
    open_, cells, width = np.arange(len(a)), first, first.width
    while len(open_):
        owners, keys, signs, empty = cells.peeled()
        order = np.argsort(owners, kind="stable")
        owners, keys, signs = owners[order], keys[order], signs[order]
        cuts = np.searchsorted(owners, np.arange(len(open_) + 1))
        for i in np.flatnonzero(empty):
            own, sign = keys[cuts[i] : cuts[i + 1]], signs[cuts[i] : cuts[i + 1]]
            out[open_[i]] = own[sign > 0], own[sign < 0]
        open_ = open_[~empty]
        if len(open_):
            least = min(abs(len(a[i]) - len(b[i])) for i in open_)
            width = 4 * width + 1
            while 3 * width < least:
                width = 4 * width + 1
            cells = Sketches.of([a[i] for i in open_], width) - Sketches.of([b[i] for i in open_], width)
    return out


def likeness(n_a: int, n_b: int, n_different: int) -> float:
    """Jaccard similarity of two sets of so many keys of which so many are not shared; of two empty ones 1."""
    shared = (n_a + n_b - n_different) // 2
    union = n_a + n_b - shared
    return shared / union if union else 1.0


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_paragraphs", pa.int64()),
    ("removed_in_edited", pa.int64()), ("added_in_edited", pa.int64()),
]
_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_paragraphs long, removed_in_edited long, added_in_edited long"
)


def _compared(pairs: list[tuple[int | None, str, np.ndarray, str, np.ndarray]]) -> list[tuple]:
    """Rows of (doc_id, text, keys) and the next document's (text, keys)."""
    new = [edited(text, other) for _, text, _, other, _ in pairs]
    new_keys = [keys_of(x) for x in new]
    keys, next_keys = [p[2] for p in pairs], [p[4] for p in pairs]
    own, changed, following = map(Sketches.of, (keys, new_keys, next_keys))
    apart = differences(keys, next_keys, own - following)
    changes = differences(keys, new_keys, own - changed)
    out = []
    for i, (doc_id, text, *_) in enumerate(pairs):
        gone, come = map(len, changes[i])
        n, m = len(keys[i]), len(new_keys[i])
        near_next = likeness(n, len(next_keys[i]), sum(map(len, apart[i])))
        sha = hashlib.sha256(new[i].encode()).hexdigest()
        out.append((doc_id, len(text), sha, likeness(n, m, gone + come), near_next, n, gone, come))
    prints = zip(own.texts(), changed.texts(), strict=True)
    return [(*r[:3], a, b, *r[3:]) for r, (a, b) in zip(out, prints, strict=True)]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its successor in the stream; a row marked ``ahead`` only ends its range."""

    def rows(pairs: list) -> pa.RecordBatch:
        cells = list(zip(*_compared(pairs), strict=True)) or [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cells, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    held, pairs, size = None, [], 0
    for batch in batches:
        columns = (batch.column(c) for c in ("ahead", "doc_id", "text"))
        for ahead, doc_id, text in zip(*columns, strict=True):
            if ahead.as_py() and held is None:
                continue
            own = text.as_py()
            keys = keys_of(own)
            if held is not None:
                pairs.append((*held, own, keys))
                size += len(own)
            held = None if ahead.as_py() else (doc_id.as_py(), own, keys)
            if len(pairs) >= PAIRS_AT_ONCE or size >= CHARS_AT_ONCE:
                yield rows(pairs)
                pairs, size = [], 0
    yield rows(pairs)


def compared(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its fingerprint, that of its edited text, and how like they and the next row's are.

    The edited text has its last half replaced by the start of the next document, in the order of doc_id; the last
    one's next is the first, and a single document's is itself. Rows that share a doc_id come in the order of a hash of
    their texts, null ids last; a null text counts as empty. Repeated rows stay. Likeness is the Jaccard similarity of
    the paragraphs, exact whatever the texts' length, 1 for two empty texts; the numbers of paragraphs that went and came
    with the edit follow. An empty table gives no rows; columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = with_next(rows.withColumn("tie", F.xxhash64("text")), "doc_id", "tie")
    return ordered.select("ahead", "doc_id", "text").mapInArrow(_streamed, _DDL)
