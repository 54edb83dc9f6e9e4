"""Connected components by alternating stars; hubs are reduced to minima before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.session import cut_lineage


def _toward_min(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of one orderable type to (node, component): the least node reachable, for every node named.

    Self-edges and repeated edges are allowed; edges with a null end are left out. A round links every
    neighbour of a node to the least one, first the larger neighbours, then the smaller; rounds go on
    until nothing changes. Their number grows with the logarithm of the longest chain. Only a count and
    a digest of the edges come to the driver.
    """
    named = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    ends = cut_lineage(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, last = ends.filter("u <> v"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_min(large)
        pairs = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("p")
        now = cut_lineage(
            small.select(pairs).select("p.u", F.col("p.m").alias("v")).filter("u <> v").distinct()
        )
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    roots = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
