"""Line dedup: sorted line hashes are streamed, and what returns per document is a bitmap of kept lines."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.session import cut_lineage

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3

LINES = "h1 long, h2 long, doc_id long, row long, pos int"


def _hashed(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            rows = batch.column("row").to_pylist()
            for doc_id, row, text in zip(ids, rows, batch.column("text"), strict=True):
                whole = (text.as_py() or "").encode()
                for pos, line in enumerate(whole.split(b"\n")):
                    key = line.strip(b" \t\n\x0b\x0c\r").lower()
                    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode()) < least_chars:
                        continue
                    h1, h2 = struct.unpack("<qq", xxhash.xxh3_128_digest(key))
                    for to, x in zip(out, (h1, h2, doc_id, row, pos), strict=True):
                        to.append(x)
                if len(out[0]) > 50_000:
                    yield _lines(out)
                    out = ([], [], [], [], [])
            yield _lines(out)

    return run


def _lines(columns: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h1", "h2", "doc_id", "row", "pos"]
    )


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition's first and last key: the greatest document here and up to three smaller ones."""
    first: list | None = None
    last: list | None = None
    part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")]
        docs = batch.column("doc_id").to_pylist()
        n = batch.num_rows
        heads = [0] + [i + 1 for i in ((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])).nonzero()[0]]
        for k in sorted({0, len(heads) - 1}):
            begin, end = heads[k], heads[k + 1] if k + 1 < len(heads) else n
            key = (int(cols[0][begin]), int(cols[1][begin]))
            if first is None:
                first = [key, []]
                last = first
            elif last[0] != key:
                last = [key, []]
            for i in range(begin, end):
                if len(last[1]) == LEAST_DOCUMENTS:
                    break
                if not last[1] or last[1][-1] != docs[i]:
                    last[1].append(docs[i])
    rows = [] if first is None else [first] if last is first else [first, last]
    yield pa.RecordBatch.from_pylist(
        [{"part": part, "h1": k[0], "h2": k[1], "docs": d} for k, d in rows],
        schema=pa.schema([("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.list_(pa.int64()))]),
    )


def _dropped(known: dict[tuple[int, int], tuple[int | None, bool]], least: int):
    """Streams sorted lines and gives those to drop.

    ``known``: of keys that meet a partition's edge, the document that keeps its lines, and whether enough
    documents hold the key. For all others the stream sees the whole key: the first document keeps its lines,
    those of the next ones wait until there are enough documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = keeper = last = None
        n_docs, shared, waiting = 0, False, []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "row", "pos")]
            for h1, h2, doc, row, pos in zip(*columns, strict=True):
                if (h1, h2) != key:
                    key, waiting, n_docs, last = (h1, h2), [], 1, doc
                    keeper, shared = known.get(key, (doc, False))
                elif doc != last:
                    n_docs, last = n_docs + 1, doc
                    shared = shared or key not in known and n_docs >= least
                if doc == keeper:
                    continue
                waiting.append((doc, row, pos))
                if shared:
                    for x in waiting:
                        for to, v in zip(out, x, strict=True):
                            to.append(v)
                    waiting = []
                elif key in known:
                    waiting = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())],
                names=["doc_id", "row", "pos"],
            )

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            bits = bytearray(b"\xff" * (max(places) // 8 + 1))
            for p in places:
                bits[p >> 3] &= ~(1 << (p & 7))
            maps.append(zlib.compress(bytes(bits), 6))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(maps, pa.binary())], names=["doc_id", "row", "keep"]
        )


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, row, keep) of every row of ``docs`` that loses lines.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. A key of at least
    ``least_chars`` code points in at least ``least_documents`` documents loses all its lines but those of the
    greatest doc_id holding it. ``keep`` is a zlib-compressed bitmap, bit i standing for line i, lines beyond
    its end stay; ``row`` tells rows with the same doc_id and different texts apart. A null id is one document,
    smaller than all others; a null text is one empty line.

    Hashes are dealt by range of (hash, document, position), so that a key of very many documents spans several
    partitions, and sorted inside; each partition is streamed once. Keys at the edges of partitions, two at
    most of each, are settled on the driver first.
    """
    if least_documents > LEAST_DOCUMENTS:
        raise ValueError(f"least_documents can be {LEAST_DOCUMENTS} at most")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("row"), F.col("pos")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    lines = cut_lineage(rows.mapInArrow(_hashed(least_chars), LINES))
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    edges: dict[tuple[int, int], list[int | None]] = {}
    found = ranged.mapInArrow(_edges, "part int, h1 long, h2 long, docs array<long>").collect()
    for r in sorted(found, key=lambda r: r["part"]):
        docs_here = edges.setdefault((r["h1"], r["h2"]), [])
        docs_here.extend(d for d in r["docs"] if d not in docs_here)
    known = {k: (d[0], len(d) >= least_documents) for k, d in edges.items()}
    dropped = ranged.mapInArrow(_dropped(known, least_documents), "doc_id long, row long, pos int")
    places = dropped.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(_bitmaps, "doc_id long, row long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines of a text that a bitmap keeps, and how many there were."""
    lines = (text or "").encode().split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = zlib.decompress(keep)
    limit = 8 * len(bits)
    return [x for i, x in enumerate(lines) if i >= limit or bits[i >> 3] >> (i & 7) & 1], len(lines)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the column ``keep``; null where every line stays."""
    right = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "keep")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_row"))
    return docs.drop("keep").join(right, same, "left").drop("_doc", "_row")


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs`` with the texts of kept lines, and ``n_lines``, ``n_dropped``, ``kept_sha256`` of each row.

    A document that loses all its lines has an empty text.
    """
    free = docs.drop("n_lines", "n_dropped", "kept_sha256", "keep")
    kept = with_bitmaps(free, keep_bitmaps(free, least_chars, least_documents))
    names = free.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped, digests = [], [], [], []
            for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True):
                lines, n = kept_lines(text.as_py(), keep.as_py())
                whole = b"\n".join(lines)
                texts.append(whole.decode())
                n_lines.append(n)
                n_dropped.append(n - len(lines))
                digests.append(hashlib.sha256(whole).hexdigest())
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())],
                names=[*names, "n_lines", "n_dropped", "kept_sha256"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in free.schema)
    return kept.mapInArrow(apply, f"{fields}, n_lines long, n_dropped long, kept_sha256 string")
