"""One row per entity with its evidence layers kept apart, and rules over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_matrix(
    entities: DataFrame,
    layers: Mapping[str, DataFrame],
    key: str,
    false_if_absent: Sequence[str],
    zero_if_absent: Sequence[str],
    criteria: Sequence[Column],
    flag: str = "screening_flag",
) -> DataFrame:
    """Left-join every layer (one row per key) and add the composite flag; unknown counts as not met.

    Layers are never merged into a score. Only the listed columns get a value where a layer
    has no row; all others stay NULL.
    """
    out = entities
    for layer in layers.values():
        out = out.join(layer, key, "left")
    for c in false_if_absent:
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    for c in zero_if_absent:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn(flag, F.coalesce(reduce(and_, criteria), F.lit(False)))


def layer_counts(pairs: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Per key how many of its items each flag holds for; ``pairs`` has one row for each item and key, so nothing is made distinct."""
    return pairs.groupBy(key).agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def criteria_report(matrix: DataFrame, key: str, criteria: Mapping[str, Column]) -> DataFrame:
    """Per key whether it meets each criterion, unknown counting as not met, and how many."""
    met = {n: F.coalesce(c, F.lit(False)).alias(n) for n, c in criteria.items()}
    total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in criteria.values()), F.lit(0))
    return matrix.select(key, *met.values(), total.alias("n_met"))


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """How many rows meet each step, in the declared order, from one pass."""
    counted = df.agg(*[F.count_if(F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, ok in enumerate(steps.values())])
    rows = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"_{i}").alias("genes")) for i, n in enumerate(steps)]
    )
    return counted.select(F.explode(rows).alias("_r")).select("_r.*")
