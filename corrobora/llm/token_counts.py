"""Token counts of whole texts: batches of about as many bytes are encoded inside Arrow functions, only lengths come out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corrobora.llm.tokens import encoder

BATCH_BYTES = 1 << 21
"""UTF-8 bytes of the texts that are encoded together; a longer text is a batch of its own, and is split inside."""


def even_slices(sizes: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``budget`` bytes each, or of a single longer row, as few as rows in order allow."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > budget:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if len(sizes) else []


def counted(docs: DataFrame, path: str, spaced: bool, limit: int) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit; texts are not returned.

    A null text counts as empty. Columns with these names are replaced. Rows are encoded in batches cut by their bytes,
    so that a batch's memory does not depend on how long its texts are; long texts are split where no token
    can reach across. Counts depend on neither. Repeated rows stay, an empty table gives no rows.
    """
    free = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = [c for c in free.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path, spaced).count_batch
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(pc.cast(whole.column("text"), pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in even_slices(sizes, BATCH_BYTES):
                batch = whole.slice(start, stop - start)
                n_tokens = count([x.as_py() or "" for x in batch.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(sizes[start:stop]), pa.array(n_tokens, pa.int64()),
                     pa.array([n > limit for n in n_tokens], pa.bool_())],
                    names=[*names, "n_bytes", "n_tokens", "over_limit"],
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in free.schema if f.name != "text")
    return free.mapInArrow(run, fields + "n_bytes long, n_tokens long, over_limit boolean")
