"""Fill-in-the-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, length) in code points: buffer ``TEXT`` is its own
text, buffer ``MARKS`` the sentinels one after the other. Neither buffer ever changes: cutting splits a descriptor, an
arrangement permutes the parts and sets a sentinel before each, and the inverse permutation restores them. Texts are
made, or hashed piece by piece, only at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, MARKS = 0, 1
SENTINELS = ("<P>", "<M>", "<S>")
"""Set before the prefix, the middle and the suffix."""

ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
"""Which of the parts prefix (0), middle (1) and suffix (2) an arrangement puts first, second and third."""

PIECE = "struct<buffer:int,start:bigint,length:bigint>"
Piece = tuple[int, int, int]


def checked(sentinels: Sequence[str]) -> tuple[str, ...]:
    """The three sentinels, if none is empty and no two can overlap where one follows the other's text."""
    marks = tuple(sentinels)
    if len(marks) != 3 or not all(marks) or len(set(marks)) != 3:
        raise ValueError("three different sentinels are needed")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
    return marks


def _piece(buffer: int, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def cut(piece: Column, at: Sequence[Column]) -> list[Column]:
    """A descriptor split after so many code points, in ascending order."""
    edges = [F.lit(0), *at, piece["length"]]
    return [_piece(TEXT, piece["start"] + a, b - a) for a, b in zip(edges, edges[1:])]


def arranged(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n, form, prefix_chars, middle_chars and ``pieces``, the descriptors of the output.

    The two cuts and the form are drawn from a hash of seed and doc_id: ``rate`` of 100 documents are transformed,
    ``spm_rate`` of 100 of those with the suffix first. A text that is empty or has a sentinel in it stays plain, with one
    descriptor and null lengths. A null text counts as empty, a null doc_id as ``null``; repeated rows stay; an empty table gives no rows.
    Other columns are not read.
    """
    marks = checked(sentinels)
    hexa = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring(F.col("_h"), 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), hexa.alias("_h")).withColumn("n", F.length("text").cast("long"))
    rows = rows.select("*", (h[0] % (F.col("n") + 1)).alias("_a"), (h[1] % (F.col("n") + 1)).alias("_b"))
    has_mark = F.col("text").contains(marks[0]) | F.col("text").contains(marks[1]) | F.col("text").contains(marks[2])
    plain = (F.col("n") == 0) | has_mark | (h[2] % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))
    whole = _piece(TEXT, F.lit(0), F.col("n"))
    parts = cut(whole, [F.least("_a", "_b"), F.greatest("_a", "_b")])
    starts = [sum(map(len, marks[:k])) for k in range(3)]
    mark = [_piece(MARKS, F.lit(starts[k]), F.lit(len(marks[k]))) for k in range(3)]
    orders = {form: F.array(*[p for k in order for p in (mark[k], parts[k])]) for form, order in ORDERS.items()}
    pieces = F.when(F.col("form") == "psm", orders["psm"]).when(F.col("form") == "spm", orders["spm"]).otherwise(F.array(whole))
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id", "text", "n", "form", F.when(moved, F.least("_a", "_b")).alias("prefix_chars"),
        F.when(moved, F.abs(F.col("_a") - F.col("_b"))).alias("middle_chars"), pieces.alias("pieces"),
    )


def output(sentinels: Sequence[str] = SENTINELS) -> Column:
    """The output text of a row of :func:`arranged`."""
    buffer = lambda p: F.when(p["buffer"] == TEXT, F.col("text")).otherwise(F.lit("".join(sentinels)))
    return F.concat_ws("", F.transform("pieces", lambda p: F.substring(buffer(p), p["start"].cast("int") + 1, p["length"].cast("int"))))


def restoring(out: str, form: str, sentinels: Sequence[str] = SENTINELS) -> list[Piece]:
    """Descriptors over an output text that give back the document: its parts by the inverse permutation."""
    if form == "plain":
        return [(TEXT, 0, len(out))]
    order = ORDERS[form]
    at = 0
    starts, stops = [], []
    for k in order:
        at = out.index(sentinels[k], at)
        stops.append(at)
        at += len(sentinels[k])
        starts.append(at)
    ends = [*stops[1:], len(out)]
    found = [(TEXT, a, b - a) for a, b in zip(starts, ends, strict=True)]
    return [found[order.index(k)] for k in range(3)]


def streamed(pieces: Sequence[Piece], buffers: Sequence[str]) -> Iterator[bytes]:
    """The pieces as UTF-8, one after the other."""
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length].encode()


def _sha256(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for p in parts:
        digest.update(p)
    return digest.hexdigest()


def digests(rows: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Rows of :func:`arranged` without text and pieces, with the hashes of the output and of what is restored from it."""
    marks = checked(sentinels)
    names = [c for c in rows.columns if c not in ("text", "pieces")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs, backs = [], []
            for text, form, pieces in zip(batch.column("text"), batch.column("form"), batch.column("pieces"), strict=True):
                table = [(p["buffer"], p["start"], p["length"]) for p in pieces.as_py()]
                buffers = (text.as_py(), "".join(marks))
                outs.append(_sha256(streamed(table, buffers)))
                out = b"".join(streamed(table, buffers)).decode()
                backs.append(_sha256(streamed(restoring(out, form.as_py(), marks), (out,))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(outs, pa.string()), pa.array(backs, pa.string())],
                names=[*names, "output_sha256", "restored_sha256"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, fields + "output_sha256 string, restored_sha256 string")
