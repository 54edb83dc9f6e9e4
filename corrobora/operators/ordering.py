"""Ranks, running totals and suffix minima over groups of any size.

A window with one huge group (or none) runs in a single task. These operators
sort the whole table by (group, order) across the cluster instead, write the
sorted copy once, and combine positions inside each sorted slice with small
per-slice offsets, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.session import cut_lineage, join_statistics

SLICE, INDEX = "_slice", "_index"


def sorted_slices(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Globally sorted copy with each row's slice number and index inside the slice.

    ``order`` must be total within a group for the result to be reproducible.
    """
    ordered = cut_lineage(df.orderBy(*[F.col(g) for g in groups], *order))
    stamp = F.monotonically_increasing_id()  # slice number in the high 31 bits, row in the low 33
    return (
        ordered.withColumn("_stamp", stamp)
        .withColumn(SLICE, F.shiftright("_stamp", 33))
        .withColumn(INDEX, F.col("_stamp").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_stamp")
    )


def _join_slices(rows: DataFrame, per: DataFrame, groups: Sequence[str]) -> DataFrame:
    return rows.join(per, [*groups, SLICE])


def rank_in_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    size: str | None = None,
    keep_slices: bool = False,
) -> DataFrame:
    """1-based position within each group (``row_number`` semantics), optionally the group size."""
    rows = sorted_slices(df, groups, order)
    per = rows.groupBy(*groups, SLICE).agg(F.count(F.lit(1)).alias("_n"), F.min(INDEX).alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    per = per.select(
        *groups,
        SLICE,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_size"),
    )
    out = _join_slices(rows, per, groups).withColumn(rank, F.col(INDEX) + F.col("_shift") + F.lit(1))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_shift", "_size", *([] if keep_slices else [SLICE, INDEX]))


def running_total(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, total: str
) -> DataFrame:
    """Inclusive running sum of ``value`` within each group, in the given order."""
    rows = sorted_slices(df, groups, order)
    per = rows.groupBy(*groups, SLICE).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*groups, SLICE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    inside = (
        Window.partitionBy(*groups, SLICE).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_inside", F.sum(value).over(inside))
    return (
        _join_slices(rows, per, groups)
        .withColumn(total, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", SLICE, INDEX)
    )


def suffix_minimum(rows: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Minimum of ``value`` over this row and all later rows of its group.

    ``rows`` comes from :func:`rank_in_group` with ``keep_slices=True``.
    """
    per = rows.groupBy(*groups, SLICE).agg(F.min(value).alias("_min"))
    # a frame that ends at the last row is re-read for every row, so order backwards instead
    later = Window.partitionBy(*groups).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*groups, SLICE, F.min("_min").over(later).alias("_later"))
    inside = (
        Window.partitionBy(*groups, SLICE).orderBy(F.desc(INDEX)).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_inside", F.min(value).over(inside))
    return (
        _join_slices(rows, per, groups)
        .withColumn(name, F.least(F.col("_inside"), F.col("_later")))
        .drop("_inside", "_later", SLICE, INDEX)
    )


def average_rank(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged. Equal values are counted first, so ties never pile up."""
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    upto = running_total(counts, groups, [F.col(value)], "_n", "_upto")
    ranks = upto.select(
        *groups, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + F.lit(1.0)) / F.lit(2.0)).alias(name)
    )
    return join_statistics(df, ranks, [*groups, value])
