"""Half-open interval joins and token joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.strings import tokens
from corrobora.session import join_statistics

LEVEL_STEP = 8


def _level_width(width: int, level: int) -> int:
    return width * LEVEL_STEP**level


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    width: int,
    chrom: str = "chrom",
    pos: str = "pos",
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Inner join of points with the half-open intervals that hold them.

    Each interval is filed under the finest bin level that covers it with at most two
    bins; there are as many levels as the longest interval asks for. Each distinct point looks at one bin per
    level. Points at the same coordinate are joined once and fanned out afterwards, so a
    hot coordinate costs one probe. Column names of the two sides must not overlap
    other than ``chrom``.
    """
    length = F.col(end) - F.col(start)
    longest = intervals.agg(F.max(length).alias("n")).first()["n"] or 1
    levels = 1
    while _level_width(width, levels - 1) < longest:
        levels += 1
    level = F.lit(levels - 1)
    for n in reversed(range(levels - 1)):
        level = F.when(length <= _level_width(width, n), n).otherwise(level)
    size = F.element_at(
        F.array(*[F.lit(_level_width(width, n)).cast("bigint") for n in range(levels)]), F.col("_level") + F.lit(1)
    )
    filed = (
        intervals.filter(length > 0)
        .withColumn("_level", level.cast("int"))
        .withColumn("_size", size)
        .withColumn(
            "_bin",
            F.explode(
                F.sequence(
                    F.floor(F.col(start) / F.col("_size")).cast("bigint"),
                    F.floor((F.col(end) - F.lit(1)) / F.col("_size")).cast("bigint"),
                )
            ),
        )
        .drop("_size")
    )
    places = points.select(chrom, pos).distinct()
    probes = F.array(
        *[
            F.struct(
                F.lit(n).alias("_level"),
                F.floor(F.col(pos) / F.lit(_level_width(width, n))).cast("bigint").alias("_bin"),
            )
            for n in range(levels)
        ]
    )
    probed = places.select(chrom, pos, F.explode(probes).alias("_p")).select(chrom, pos, "_p.*")
    hits = (
        probed.join(filed, [chrom, "_level", "_bin"])
        .filter((F.col(start) <= F.col(pos)) & (F.col(pos) < F.col(end)))
        .drop("_level", "_bin")
    )
    return points.join(hits, [chrom, pos])


def closed_to_half_open(df: DataFrame, stop: str, end: str = "end") -> DataFrame:
    """Inclusive stops become exclusive ends."""
    return df.withColumn(end, F.col(stop) + F.lit(1))


def endpoint_sensitivity(hits: DataFrame, pos: str = "pos", start: str = "start", stop: str = "stop") -> DataFrame:
    """Whether a hit also holds when the published stop is read as exclusive."""
    return hits.withColumn("robust_to_endpoint", (F.col(start) <= F.col(pos)) & (F.col(pos) < F.col(stop)))


def loop_links(points: DataFrame, loops: DataFrame, width: int) -> DataFrame:
    """Points in one anchor of a loop whose gene is listed at the other anchor, both ways round.

    ``points`` has chrom, pos and gene; ``loops`` has loop_id and, for anchors 1 and 2,
    chrom, start, end and a comma list of genes.
    """
    sides = []
    for here, there in ((1, 2), (2, 1)):
        sides.append(
            F.struct(
                F.col(f"anchor_{here}_chrom").alias("chrom"),
                F.col(f"anchor_{here}_start").cast("bigint").alias("start"),
                F.col(f"anchor_{here}_end").cast("bigint").alias("end"),
                tokens(F.col(f"anchor_{there}_genes")).alias("_genes"),
                F.lit(here).alias("variant_anchor"),
                F.lit(there).alias("gene_anchor"),
            )
        )
    anchors = loops.select("loop_id", F.explode(F.array(*sides)).alias("_s")).select("loop_id", "_s.*")
    return (
        point_in_interval(points, anchors, width)
        .filter(F.array_contains("_genes", F.col("gene")))
        .drop("_genes", "start", "end")
    )


def token_join(df: DataFrame, text: str, names: DataFrame, name: str, separator: str = ",") -> DataFrame:
    """Rows joined with the listed names that occur as whole tokens of ``text``."""
    exploded = df.withColumn(name, F.explode(F.array_distinct(tokens(F.col(text), separator))))
    return join_statistics(exploded, names, [name])


def canonical_labels(df: DataFrame, text: str, mapping: Mapping[str, str], name: str) -> DataFrame:
    """Token list recoded to a sorted distinct list; tokens outside the mapping are listed separately."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = tokens(F.col(text))
    return df.withColumn(
        name,
        F.array_sort(
            F.array_distinct(
                F.filter(F.transform(found, lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull())
            )
        ),
    ).withColumn("unknown_labels", F.filter(found, lambda t: F.try_element_at(table, t).isNull()))


def overlap_labels(hits: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Sorted distinct labels of the intervals each point falls into."""
    return hits.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias(name))


def regulatory_table(
    pairs: DataFrame,
    overlaps: DataFrame,
    links: DataFrame,
    contexts: DataFrame,
    link_columns: Sequence[str],
    variant: str = "variant_id",
    gene: str = "gene",
) -> DataFrame:
    """Variant by gene evidence: overlapped types, link flags, and whether the source assessed it.

    ``links`` has one row per assessed variant with token-list columns; a variant it lacks is
    ``not_in_source_table``, which is no negative finding beyond its false flags.
    """
    joined = (
        pairs.join(overlaps, variant, "left")
        .join(links.withColumn("_assessed", F.lit(True)), variant, "left")
        .join(contexts, gene, "left")
    )
    types = F.coalesce("types", F.array().cast("array<string>"))
    flag = lambda c: F.coalesce(F.array_contains(tokens(F.col(c), " "), F.col(gene)), F.lit(False))
    out = joined.select(
        *pairs.columns,
        F.col("_assessed").isNotNull().alias("assessed"),
        F.when(F.col("_assessed"), "source_assessed").otherwise("not_in_source_table").alias("assessment_status"),
        F.array_join(types, ";").alias("overlap_types"),
        F.coalesce(F.array_contains(types, F.col("top_type")), F.lit(False)).alias("top_type_overlaps"),
        *[flag(c).alias(f"{c}_match") for c in link_columns],
    )
    any_link = F.lit(False)
    for c in link_columns:
        any_link = any_link | F.col(f"{c}_match")
    return out.withColumn("any_link", any_link)


def label_agreement(computed: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Set equality of two label arrays for every published key; a key without hits compares as empty."""
    empty = F.array().cast("array<string>")
    c = computed.select(key, F.col("types").alias("_c"))
    return published.join(c, key, "left").select(
        key,
        F.array_join(F.coalesce("_c", empty), ";").alias("computed_types"),
        F.array_join("types", ";").alias("published_types"),
        (F.coalesce("_c", empty) == F.col("types")).alias("types_agree"),
    )


def resolve_coordinates(
    records: DataFrame, key: str, mappings: Column, assembly: str, chrom: Column
) -> DataFrame:
    """Unique single-base mapping on one assembly and chromosome, or an ambiguous status.

    ``mappings`` is an array of structs with assembly_name, seq_region_name, start and end.
    """
    good = F.filter(
        mappings,
        lambda m: (m["assembly_name"] == assembly) & (m["seq_region_name"] == chrom) & (m["start"] == m["end"]),
    )
    places = F.array_distinct(F.transform(F.coalesce(good, F.array()), lambda m: m["start"]))
    unique = F.size(places) == 1
    return records.select(
        key,
        chrom.alias("chrom"),
        F.when(unique, F.get(places, F.lit(0))).alias("position"),
        F.when(unique, "unique_position").otherwise("not_returned_or_ambiguous").alias("status"),
    )
