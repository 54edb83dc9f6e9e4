"""Integration of thresholded association records under several evidence rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.numeric import log2_contrast, share
from corrobora.functions.strings import list_text
from corrobora.operators.ranking import first_maximum

CONTEXT = ("locus", "gene_id", "gene", "qtl_type", "tissue")
RULES = (
    "baseline_union",
    "strict_union",
    "baseline_same_context_agreement",
    "strict_same_context_agreement",
)


def flag_thresholds(
    records: DataFrame, baseline: Mapping[str, float], strict: Mapping[str, float]
) -> DataFrame:
    """Method-specific baseline and strict flags; a record must pass QC and exceed the threshold."""

    def limit(levels: Mapping[str, float]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
        return F.try_element_at(table, F.col("method"))

    passed = lambda levels: F.coalesce(F.col("qc_pass") & (F.col("score") > limit(levels)), F.lit(False))
    return records.withColumn("baseline_pass", passed(baseline)).withColumn("strict_pass", passed(strict))


def record_audit(records: DataFrame, focus_tissue: str) -> DataFrame:
    """Records per method, and how many pass each step."""
    return records.groupBy("method").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("qc_pass").alias("qc_pass_records"),
        F.count_if("baseline_pass").alias("baseline_pass_records"),
        F.count_if("strict_pass").alias("strict_pass_records"),
        F.count_if(F.col("tissue") == focus_tissue).alias("focus_tissue_records"),
    )


def evidence_matrix(records: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per context; per method the best score and whether any record passed.

    A method without a record keeps a NULL score but has false flags.
    """
    aggs = []
    for m in methods:
        mine = F.col("method") == m
        aggs += [
            F.max(F.when(mine, F.col("score"))).alias(f"{m}_score"),
            F.coalesce(F.bool_or(F.when(mine, F.col("baseline_pass"))), F.lit(False)).alias(f"{m}_baseline_pass"),
            F.coalesce(F.bool_or(F.when(mine, F.col("strict_pass"))), F.lit(False)).alias(f"{m}_strict_pass"),
        ]
    wide = records.groupBy(*CONTEXT).agg(*aggs)
    for tier in ("baseline", "strict"):
        flags = [F.col(f"{m}_{tier}_pass") for m in methods]
        union, agree = flags[0], flags[0]
        for f in flags[1:]:
            union, agree = union | f, agree & f
        wide = wide.withColumn(f"{tier}_union", union).withColumn(f"{tier}_same_context_agreement", agree)
    return wide


def rule_counts(wide: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """Distinct loci, genes, pairs and contexts kept under each rule; empty rules count zero.

    Contexts are first reduced to distinct pairs, so the distinct counts work on
    little data and no rule collects its keys in one place.
    """
    pairs = wide.groupBy("locus", "gene_id").agg(
        *[F.count_if(r).alias(r) for r in rules]
    )
    long = pairs.select(
        "locus",
        "gene_id",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("_r"),
    ).select("locus", "gene_id", "_r.rule", F.col("_r.n").alias("n"))
    hit = F.col("n") > 0
    return long.groupBy("rule").agg(
        F.countDistinct(F.when(hit, F.col("locus"))).alias("loci"),
        F.countDistinct(F.when(hit, F.col("gene_id"))).alias("genes"),
        F.count_if(hit).alias("locus_gene_pairs"),
        F.sum("n").alias("qtl_tissue_contexts"),
    )


def gene_rollup(wide: DataFrame, focus_tissue: str, focus_qtl: str) -> DataFrame:
    """Supported contexts rolled up to genes, with the sorted list of loci as text."""
    kept = wide.filter("baseline_union")
    focus = (F.col("tissue") == focus_tissue) & (F.col("qtl_type") == focus_qtl)
    return kept.groupBy("gene_id", "gene").agg(
        F.countDistinct("locus").alias("n_loci"),
        F.count(F.lit(1)).alias("n_contexts"),
        F.bool_or(focus).alias("focus_support"),
        F.bool_or(focus & F.col("strict_union")).alias("strict_focus_support"),
        F.bool_or("baseline_same_context_agreement").alias("same_context_agreement"),
        F.bool_or("strict_same_context_agreement").alias("strict_same_context_agreement"),
        list_text(F.col("locus").cast("string")).alias("loci"),
    )


def class_means(expression: DataFrame, clusters: Mapping[str, Sequence[str]]) -> DataFrame:
    """Gene by class means where each cluster has one vote within its class.

    ``expression`` is sparse ``(gene_id, cluster, value)``: an absent row is a zero, so
    the sum is divided by the declared number of clusters. Long form, one row per gene
    of the matrix and class.
    """
    to_class = F.create_map(*[F.lit(x) for c, members in clusters.items() for m in members for x in (m, c)])
    coded = expression.withColumn("_class", F.try_element_at(to_class, F.col("cluster")))
    names = list(clusters)
    wide = coded.groupBy("gene_id").agg(
        *[
            (F.coalesce(F.sum(F.when(F.col("_class") == c, F.col("value"))), F.lit(0.0)) / F.lit(float(len(clusters[c])))).alias(
                f"_c{i}"
            )
            for i, c in enumerate(names)
        ]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_c{i}").alias("value")) for i, c in enumerate(names)])
    return wide.select("gene_id", F.explode(rows).alias("_x")).select("gene_id", "_x.*")


def class_shares(expression: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Wide shares of each gene's total; a gene with no expression has NULL shares."""
    wide = expression.groupBy("gene_id").agg(
        *[F.max(F.when(F.col("class") == c, F.col("value"))).alias(c) for c in classes]
    )
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return wide.select(
        "gene_id", *[F.col(c) for c in classes], *[share(F.col(c), total).alias(f"{c}_share") for c in classes]
    )


def gene_priorities(rollup: DataFrame, shares: DataFrame, classes: Sequence[str], focus: str) -> DataFrame:
    """Left enrichment of the roll-up with class expression and its contrasts.

    The highest class is the earliest declared one on a tie and is only given when every
    share is known.
    """
    joined = rollup.join(shares, "gene_id", "left")
    matched = F.col(f"{classes[0]}").isNotNull()
    usable = F.col(f"{classes[0]}_share").isNotNull()
    best = F.greatest(*[F.col(c) for c in classes])
    highest = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in classes])
    others = [F.col(c) for c in classes if c != focus]
    return (
        joined.withColumn("atlas_matched", matched)
        .withColumn("highest_class", F.when(usable, highest))
        .withColumn("focus_vs_others_log2", F.when(matched, log2_contrast(F.col(focus), others)))
    )


def highest_class(expression: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Class of the largest value per gene, from the long form."""
    return expression.groupBy("gene_id").agg(first_maximum("class", "value", classes).alias("highest_class"))
