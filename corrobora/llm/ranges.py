"""Rows in one order over the cluster, each partition with the first row of what comes after it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_TASK = 8
"""Ranges for each shuffle partition, so that partitions even out."""


class Ranges:
    """Split points of an order by (id, tie), null ids last.

    An id that holds more rows than a range has is split by its tie; so are null ids. The number of split points
    follows the number of shuffle partitions, never the rows.
    """

    def __init__(self, rows: DataFrame, key: str) -> None:
        n = PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = [i / n for i in range(1, n)]
        id_ = F.col(key).cast("long")
        found = rows.agg(
            F.percentile_approx(id_, shares, 10 * n).alias("splits"), F.count(F.lit(1)).alias("all"), F.count(id_).alias("named")
        ).first()
        self.splits = np.array(found["splits"] or [], np.int64)
        missing = found["all"] - found["named"]
        self.null_ranges = 1 + n * missing // max(1, found["all"])

    def of(self, ids: pd.Series, ties: np.ndarray) -> np.ndarray:
        """Range of each row, never falling in the order."""
        share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
        known = ids.notna().to_numpy()
        plain = ids.fillna(0).to_numpy(np.int64)
        left = np.searchsorted(self.splits, plain, "left")
        same = np.searchsorted(self.splits, plain, "right") - left
        named = left + np.minimum(same, np.floor(share * (same + 1)).astype(np.int64))
        nameless = len(self.splits) + 1 + np.minimum(self.null_ranges - 1, np.floor(share * self.null_ranges).astype(np.int64))
        return np.where(known, named, nameless)


def with_next(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """``rows`` sorted by (key, tie), null keys last, within ranges: columns ``range`` and ``ahead`` are added.

    A partition holds whole ranges in order. The first row of the next range that has rows, after the last range the first
    of all, stands also at the end of each range, marked ``ahead``; of equal first rows all do. So every row finds
    its successor in its own partition. Rows are shuffled once; only the split points and one (key, tie)
    for each range come to the driver.
    """
    ranges = Ranges(rows, key)

    @F.pandas_udf("long")
    def place(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(ids.astype("Int64"), ties.to_numpy()))

    placed = rows.withColumn("range", place(F.col(key).cast("long"), F.col(tie)))
    first = F.min(F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("id"), F.col(tie).alias("tie"))).alias("f")
    firsts = [(r["range"], r["f"]["id"], r["f"]["tie"]) for r in placed.groupBy("range").agg(first).collect()]
    firsts.sort()
    before = {this[0]: firsts[i - 1][0] for i, this in enumerate(firsts)}
    heads = {r: (i, t) for r, i, t in firsts}

    @F.pandas_udf("long")
    def earlier(found: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        """The range before, for the first row of a range."""
        rows = zip(found, ids.astype("Int64"), ties, strict=True)
        return pd.Series([before[r] if heads[r] == (None if i is pd.NA else i, t) else None for r, i, t in rows], dtype="Int64")

    both = F.array(
        F.struct(F.col("range"), F.lit(False).alias("ahead")),
        F.struct(earlier("range", F.col(key).cast("long"), F.col(tie)).alias("range"), F.lit(True).alias("ahead")),
    )
    dealt = placed.withColumn("_p", F.explode(both)).filter("_p.range IS NOT NULL").select(*rows.columns, "_p.range", "_p.ahead")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "range").sortWithinPartitions("range", "ahead", F.col(key).isNull(), key, tie)
