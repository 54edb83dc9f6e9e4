"""Digest trees: SHA-256 of fixed-length chunks, and of a file's chunk digests together, for files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.sources.tables import compare_registry

CHUNK = 64 << 20
"""Bytes of a chunk; digests of files are comparable only for one length of chunk."""

_PIECE = 1 << 20


def chunk_count(size: Column, chunk: int) -> Column:
    """Chunks of so many bytes; an empty content has one, which is empty."""
    return F.greatest(F.lit(1), F.ceil(size / F.lit(chunk))).cast("long")


def leaf_digests(content: Column, chunk: int = CHUNK) -> Column:
    """Digests of the chunks of a binary value, in order; null for null."""
    last = chunk_count(F.octet_length(content), chunk).cast("int") - 1
    part = lambda i: F.substring(content, i * F.lit(chunk) + 1, F.lit(chunk))
    return F.when(content.isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(part(i), 256)))


def root_digest(leaves: Column, size: Column) -> Column:
    """One digest of the size and all chunk digests."""
    return F.sha2(F.concat(size.cast("string"), F.lit(":"), F.concat_ws("", leaves)), 256)


def _opened(uri: str) -> pa.NativeFile:
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return store.open_input_file(path)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes_found) of every file below ``path``. The scan passes over empty files, so they come from its list of names."""
    scan = spark.read.format("binaryFile").load(path)
    found = scan.select("path", F.col("length").alias("bytes_found"))
    names = [(unquote(u).replace("file:///", "file:/", 1),) for u in scan.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(found, "path", "left_anti")
    return found.unionByName(empty.withColumn("bytes_found", F.lit(0).cast("long")))


def file_leaves(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, bytes_found, chunk, digest) of every file below ``path``, names relative to nothing but the last part.

    Spark lists the files without reading them; their chunks are dealt to the tasks one by one, so a file of any size is
    read in parallel and a lost executor repeats its chunks only. Workers must reach the store of ``path``.
    """
    last = chunk_count(F.col("bytes_found"), chunk) - 1
    todo = listed_files(spark, path).select("path", "bytes_found", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for uri, size, number in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes_found", "chunk")), strict=True):
                digest, left = hashlib.sha256(), min(chunk, size - number * chunk)
                with _opened(uri) as file:
                    file.seek(number * chunk)
                    while left > 0:
                        piece = file.read(min(left, _PIECE))
                        if not piece:
                            raise OSError(f"{uri} became shorter while it was read")
                        digest.update(piece)
                        left -= len(piece)
                digests.append(digest.hexdigest())
            names = pa.array([u.rsplit("/", 1)[-1] for u in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, batch.column("bytes_found"), batch.column("chunk"), pa.array(digests, pa.string())], names=["file", "bytes_found", "chunk", "digest"])

    return todo.repartition("path", "chunk").mapInArrow(read, "file string, bytes_found long, chunk long, digest string")


def file_roots(leaves: DataFrame) -> DataFrame:
    """(file, bytes_found, n_chunks, root_found) from the chunks of files. One file's digests meet in one row: 16,384 for each TiB."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"])
    whole = leaves.groupBy("file", "bytes_found").agg(ordered.alias("_leaves"))
    return whole.select("file", "bytes_found", F.size("_leaves").cast("long").alias("n_chunks"), root_digest(F.col("_leaves"), F.col("bytes_found")).alias("root_found"))


def tree_registry(spark: SparkSession, path: str, declared: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every file against its declared (file, root, bytes), with the statuses of ``tables.compare_registry``."""
    found = file_roots(file_leaves(spark, path, chunk)).withColumnRenamed("root_found", "sha256_found")
    return compare_registry(declared.withColumnRenamed("root", "sha256"), found).select(
        "file", "bytes", "bytes_found", "n_chunks", F.col("sha256_found").alias("root_found"), "status"
    )


def changed_chunks(found: DataFrame, declared: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks (file, chunk, digest) that differ, are new or are gone, with the offset at which each starts."""
    b = declared.select("file", "chunk", F.col("digest").alias("_declared"))
    a = found.select("file", "chunk", "digest")
    status = F.when(F.col("_declared").isNull(), "new").when(F.col("digest").isNull(), "gone").otherwise("changed")
    return (
        a.join(b, ["file", "chunk"], "full_outer")
        .filter(~F.col("digest").eqNullSafe(F.col("_declared")))
        .select("file", "chunk", (F.col("chunk") * chunk).alias("offset"), status.alias("status"))
    )
