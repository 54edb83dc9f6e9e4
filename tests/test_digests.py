"""Digest trees of files and contents against hashlib."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corrobora.sources import digests as dg


def tree(data: bytes, chunk: int) -> tuple[list[str], str]:
    parts = [data[i : i + chunk] for i in range(0, max(1, len(data)), chunk)]
    leaves = [hashlib.sha256(p).hexdigest() for p in parts]
    return leaves, hashlib.sha256(f"{len(data)}:{''.join(leaves)}".encode()).hexdigest()


CONTENTS = {"empty.bin": b"", "one.bin": b"x", "even.bin": bytes(range(256)) * 4, "odd name é.bin": b"\x00\xff\r\n" * 333}


def test_files_and_values_have_the_same_tree(spark, tmp_path):
    for name, data in CONTENTS.items():
        (tmp_path / name).write_bytes(data)
    leaves = dg.file_leaves(spark, str(tmp_path), 128)
    got = {r["file"]: (r["bytes_found"], r["n_chunks"], r["root_found"]) for r in dg.file_roots(leaves).collect()}
    assert got == {n: (len(d), len(tree(d, 128)[0]), tree(d, 128)[1]) for n, d in CONTENTS.items()}
    values = spark.createDataFrame([(n, bytearray(d)) for n, d in CONTENTS.items()] + [("null", None)], "file string, content binary")
    own = {r["file"]: r["l"] for r in values.select("file", dg.leaf_digests(F.col("content"), 128).alias("l")).collect()}
    assert own == {**{n: tree(d, 128)[0] for n, d in CONTENTS.items()}, "null": None}


def test_registry_and_changed_chunks(spark, tmp_path):
    data = bytearray(b"abcdefgh" * 100)
    before = [("a", i, h) for i, h in enumerate(tree(bytes(data), 64)[0])]
    declared = spark.createDataFrame([("a", tree(bytes(data), 64)[1], 800), ("gone", "0", 1), ("b", tree(b"y", 64)[1], 1)], "file string, root string, bytes long")
    data[200] ^= 1
    (tmp_path / "a").write_bytes(data + b"!" * 40)
    (tmp_path / "b").write_bytes(b"y")
    (tmp_path / "c").write_bytes(b"z")
    status = {r["file"]: r["status"] for r in dg.tree_registry(spark, str(tmp_path), declared, 64).collect()}
    assert status == {"a": "size_mismatch", "b": "verified", "c": "undeclared_file", "gone": "missing_file"}
    leaves = dg.file_leaves(spark, str(tmp_path), 64).filter("file = 'a'")
    known = spark.createDataFrame(before, "file string, chunk long, digest string")
    changed = {(r["chunk"], r["offset"], r["status"]) for r in dg.changed_chunks(leaves, known, 64).collect()}
    assert changed == {(3, 192, "changed"), (12, 768, "changed"), (13, 832, "new")}


def test_a_file_beyond_two_gib_is_verified_and_a_changed_byte_found(spark, tmp_path):
    size, chunk, at = 3 << 30, 256 << 20, (2 << 30) + 12_345
    path = tmp_path / "sparse.bin"
    with path.open("wb") as f:
        f.truncate(size)
    zero = hashlib.sha256(bytes(chunk)).hexdigest()
    root = hashlib.sha256(f"{size}:{zero * (size // chunk)}".encode()).hexdigest()
    declared = spark.createDataFrame([("sparse.bin", root, size)], "file string, root string, bytes long")
    assert dg.tree_registry(spark, str(tmp_path), declared, chunk).first()["status"] == "verified"
    with path.open("r+b") as f:
        f.seek(at)
        f.write(b"\x01")
    assert dg.tree_registry(spark, str(tmp_path), declared, chunk).first()["status"] == "digest_mismatch"
    known = spark.range(size // chunk).select(F.lit("sparse.bin").alias("file"), F.col("id").alias("chunk"), F.lit(zero).alias("digest"))
    assert [r["chunk"] for r in dg.changed_chunks(dg.file_leaves(spark, str(tmp_path), chunk), known, chunk).collect()] == [at // chunk]
