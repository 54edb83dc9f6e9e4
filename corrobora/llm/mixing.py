"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.session import cut_lineage, scratch_path

LARGEST_PART = 500.0
"""A higher mean is drawn as a sum of equal parts, as exp(-mean) must not vanish."""

HASH_BITS = 52


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of ``HASH_BITS`` bits from the MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long").cast("double") / float(1 << HASH_BITS)


def rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, size: float = 1.0
) -> DataFrame:
    """Per source its characters, target weight and ``rate``, the mean number of copies of each of its documents.

    The output has ``size`` times the input's characters on average. ``weights`` names the target weight of
    each source (sources not named get 0 and drop out); without it a source's weight is its characters to the
    power ``temperature``. Null sources form one source of their own; a source without characters counts
    as one character a document.
    """
    sized = docs.groupBy("source").agg(
        F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")).alias("chars")
    )
    if weights is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == name, F.lit(float(w))).otherwise(raw)
    weighted = cut_lineage(sized).withColumn("raw", raw)
    totals = weighted.agg(F.sum("raw").alias("raw"), F.sum("chars").alias("chars"))
    share = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(0.0)
    return (
        weighted.withColumn("all_raw", totals.select("raw").scalar())
        .withColumn("all_chars", totals.select("chars").scalar())
        .withColumn("weight", share)
        .withColumn("rate", F.col("weight") * F.lit(size) * F.col("all_chars") / F.col("chars"))
        .select("source", "chars", "weight", "rate")
    )


def _thresholds(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... until the hash's last bit cannot tell it from 1."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    begin = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, step, lambda s: s["cdf"])


def mixed(
    docs: DataFrame,
    seed: int,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
) -> DataFrame:
    """The documents, each as often as a hash-seeded Poisson draw says, in an order that mixes all sources.

    The draw inverts the Poisson distribution of the source's rate at a hash of seed and doc_id, so it does not
    depend on partitioning; rows with the same doc_id and source have the same number of copies. Adds
    ``copy`` (from 0) and ``mix_key``, a hash; rows are dealt to partitions by it and sorted by it inside.
    Columns of these names in ``docs`` are replaced. An empty table gives an empty table.
    """
    free = docs.drop("copy", "mix_key")
    drawn = rates(free, weights, temperature, size).withColumn(
        "_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_PART).cast("int"))
    )
    drawn = drawn.select(
        F.col("source").alias("_source"), "_parts", _thresholds(F.col("rate") / F.col("_parts")).alias("_cdf")
    )
    # Written, its size is known: Spark broadcasts a small table of sources, or deals out a large one.
    path = scratch_path(free.sparkSession, "source-rates")
    drawn.write.parquet(path)
    drawn = free.sparkSession.read.parquet(path)
    copies = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.col("_parts")),
            lambda part: F.size(
                F.filter("_cdf", lambda t: t <= uniform(seed, F.col("doc_id"), part))
            ),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    key = F.conv(
        F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy")), 1, 13), 16, 10
    ).cast("long")
    return (
        free.join(drawn, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies)
        .filter("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .drop("_source", "_parts", "_cdf", "_copies")
        .withColumn("mix_key", key)
        .repartition("mix_key")
        .sortWithinPartitions("mix_key", "doc_id")
    )
