"""Token-id files: documents in ascending order, their ids range-coded in checksummed blocks.

A file set is a folder of Parquet files whose rows are records, a record being whole documents in order:

=========  ======================================================================
file       number of the file in the order of documents
record     number of the record in its file
n_docs     documents in the record
n_ids      ids in the record
payload    ``TOKR``, number of documents and of blocks; per document its id (or the least
           64-bit integer for null) and number of ids; per block its number of ids, of bytes,
           and the CRC-32 of its ids as little-endian unsigned 32-bit integers; the blocks' bytes;
           the CRC-32 of all that
=========  ======================================================================

All numbers are little-endian. Blocks are coded by ``range_coder`` and can be read apart from each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.llm import range_coder
from corrobora.llm.tokens import encoder

RECORD_IDS = 64 * range_coder.BLOCK
"""A record is closed at this many ids; a longer document has a record of its own size."""

HELD_IDS = range_coder.LANES * range_coder.BLOCK
"""Ids that a task holds before it codes them side by side."""

NULL_ID = -(1 << 63)
RECORDS = "file int, record int, n_docs int, n_ids long, payload binary"


def _payloads(records: list[tuple[list[int], list[np.ndarray]]]) -> Iterator[tuple[int, int, bytes]]:
    """(documents, ids, payload) of records given as doc_ids and ids of each document."""
    cut: list[list[np.ndarray]] = []
    for _, ids in records:
        whole = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        cut.append([whole[i : i + range_coder.BLOCK] for i in range(0, len(whole), range_coder.BLOCK)])
    coded = iter(range_coder.encode([b for blocks in cut for b in blocks]))
    for (doc_ids, ids), blocks in zip(records, cut, strict=True):
        data = [next(coded) for _ in blocks]
        head = [b"TOKR", struct.pack("<II", len(doc_ids), len(blocks))]
        head += [struct.pack("<qQ", d, len(x)) for d, x in zip(doc_ids, ids, strict=True)]
        head += [
            struct.pack("<III", len(b), len(x), zlib.crc32(b.astype("<u4").tobytes()))
            for b, x in zip(blocks, data, strict=True)
        ]
        body = b"".join(head + data)
        yield len(doc_ids), sum(map(len, ids)), body + struct.pack("<I", zlib.crc32(body))


def _coded(path: str, spaced: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced).encode_batch
        held: list[tuple[list[int], list[np.ndarray]]] = []
        file, record, n_held, n_open = 0, 0, 0, RECORD_IDS

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal record, held, n_held, n_open
            rows = [
                {"file": file, "record": record + i, "n_docs": n, "n_ids": m, "payload": p}
                for i, (n, m, p) in enumerate(_payloads(held))
            ]
            record, held, n_held, n_open = record + len(rows), [], 0, RECORD_IDS
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema([("file", pa.int32()), ("record", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            coded = encode(text.as_py() for text in batch.column("text"))
            for doc_id, part, ids in zip(docs, batch.column("file").to_pylist(), coded, strict=True):
                if max(int(ids.max(initial=0)), end_id) > 65535:
                    raise ValueError("the format holds ids below 65,536")
                if n_open >= RECORD_IDS:
                    if n_held >= HELD_IDS:
                        yield from flush()
                    held.append(([], []))
                    n_open = 0
                file = part
                held[-1][0].append(NULL_ID if doc_id is None else doc_id)
                held[-1][1].append(np.append(ids, end_id).astype(np.uint16))
                n_open += len(ids) + 1
                n_held += len(ids) + 1
        if held:
            yield from flush()

    return run


def write(docs: DataFrame, folder: str, path: str, spaced: bool, end_id: int) -> None:
    """Writes the ids of ``docs`` (doc_id, text), each document's followed by ``end_id``, to a new folder.

    Documents are dealt to files by range of doc_id, nulls first, and sorted in each; of rows that share a
    doc_id the order is that of a hash of their texts. A null text is empty. An empty table gives no record.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("file", F.spark_partition_id()).mapInArrow(_coded(path, spaced, end_id), RECORDS).write.parquet(folder)


def parsed(payload: bytes) -> tuple[list[tuple[int | None, int]], list[tuple[int, int, bytes]]]:
    """The documents (id, number of ids) and blocks (number of ids, CRC-32, bytes) of a record; damage is an error."""
    if payload[:4] != b"TOKR" or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged record")
    n_docs, n_blocks = struct.unpack_from("<II", payload, 4)
    docs = [struct.unpack_from("<qQ", payload, 12 + 16 * i) for i in range(n_docs)]
    at = 12 + 16 * n_docs
    heads = [struct.unpack_from("<III", payload, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    blocks = []
    for n, size, crc in heads:
        blocks.append((n, crc, payload[at : at + size]))
        at += size
    return [(None if d == NULL_ID else d, n) for d, n in docs], blocks


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its place in the record, number of ids and their bytes; records are decoded side by side."""
    held: list[tuple[int, int, list, list]] = []
    lanes = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids = range_coder.decode([(n, data) for *_, blocks in held for n, _, data in blocks])
        at = 0
        for file, record, docs, blocks in held:
            own = [x.astype("<u4") for x in ids[at : at + len(blocks)]]
            at += len(blocks)
            for x, (_, crc, _) in zip(own, blocks, strict=True):
                if zlib.crc32(x.tobytes()) != crc:
                    raise ValueError(f"damaged block in file {file}, record {record}")
            whole = np.concatenate(own) if own else np.zeros(0, "<u4")
            starts = np.cumsum([0] + [n for _, n in docs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(docs), pa.int32()),
                    pa.array([record] * len(docs), pa.int32()),
                    pa.array([d for d, _ in docs], pa.int64()),
                    pa.array(starts[:-1], pa.int64()),
                    pa.array([n for _, n in docs], pa.int64()),
                    pa.array([whole[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary()),
                ],
                names=["file", "record", "doc_id", "before", "n_tokens", "ids"],
            )

    for batch in batches:
        for file, record, payload in zip(batch.column("file").to_pylist(), batch.column("record").to_pylist(), batch.column("payload"), strict=True):
            docs, blocks = parsed(payload.as_py())
            held.append((file, record, docs, blocks))
            lanes += len(blocks)
            if lanes >= range_coder.LANES:
                yield from flush()
                held, lanes = [], 0
    yield from flush()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, record, doc_id, before, n_tokens, ids): each document's ids as bytes; ``before`` counts within its record."""
    records = spark.read.parquet(folder).select("file", "record", "payload")
    return records.mapInArrow(_decoded, "file int, record int, doc_id long, before long, n_tokens long, ids binary")


def record_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, record, first): the ids of all records before each one, from the record heads alone."""
    heads = spark.read.parquet(folder).select("file", "record", "n_ids")
    files = heads.groupBy("file").agg(F.sum("n_ids").alias("in_file"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", F.coalesce(F.sum("in_file").over(earlier), F.lit(0)).alias("file_first"))
    within = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    return (
        heads.withColumn("first", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(files, "file")
        .select("file", "record", (F.col("first") + F.col("file_first")).alias("first"))
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts all ids before it."""
    placed = read(spark, folder).select("file", "record", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return placed.join(record_starts(spark, folder), ["file", "record"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
