"""Gene programs: coverage, matched-control contrasts and their comparison between studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.numeric import share
from corrobora.functions.strings import list_text
from corrobora.operators.ranking import ALL_DONORS, TIE_TOLERANCE, comparisons, omission_sets


def panel_coverage(panels: DataFrame, expressed: DataFrame, min_genes: int, min_fraction: float) -> DataFrame:
    """Panel size, expressed members, fraction and eligibility of each program."""
    found = expressed.select("gene_id").distinct().withColumn("_in", F.lit(True))
    n = F.count(F.lit(1))
    hit = F.count("_in")
    return panels.join(found, "gene_id", "left").groupBy("program").agg(
        n.alias("panel_size"),
        hit.alias("expressed_members"),
        (hit / n).alias("coverage_fraction"),
        ((hit >= min_genes) & (hit / n >= min_fraction)).alias("eligible"),
    )


def membership_table(genes: DataFrame, panels: DataFrame, programs: Sequence[str]) -> DataFrame:
    """Gene by program membership, one row for every gene and declared program."""
    member = panels.select("program", "gene_id").distinct().withColumn("_in", F.lit(True))
    frame = genes.select("gene_id").withColumn("program", F.explode(F.array(*[F.lit(p) for p in programs])))
    return frame.join(member, ["program", "gene_id"], "left").select(
        "gene_id", "program", F.col("_in").isNotNull().alias("member")
    )


def membership_text(panels: DataFrame) -> DataFrame:
    """Sorted list of a gene's programs as text."""
    return panels.groupBy("gene_id").agg(list_text(F.col("program")).alias("programs"))


def contrast_weights(pairs: DataFrame) -> DataFrame:
    """One signed weight per program and gene from (program, panel_gene, control_gene) pairs.

    A panel gene weighs ``1/n`` and each of its ``m`` controls ``-1/(n m)``; repeated controls
    add up. The score of a group is then one weighted sum over genes.
    """
    per_gene = pairs.groupBy("program", "panel_gene").agg(F.count(F.lit(1)).alias("_m"))
    size = per_gene.groupBy("program").agg(F.count(F.lit(1)).alias("_n"))
    plus = per_gene.join(size, "program").select(
        "program", F.col("panel_gene").alias("gene_id"), (F.lit(1.0) / F.col("_n")).alias("weight")
    )
    minus = (
        pairs.join(per_gene, ["program", "panel_gene"])
        .join(size, "program")
        .select(
            "program",
            F.col("control_gene").alias("gene_id"),
            (F.lit(-1.0) / (F.col("_n") * F.col("_m"))).alias("weight"),
        )
    )
    return plus.unionByName(minus).groupBy("program", "gene_id").agg(F.sum("weight").alias("weight"))


def program_scores(cube: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum of log CPM per group and program; groups without cells have no score."""
    return (
        cube.filter(F.col("log1p_cpm").isNotNull())
        .join(weights, "gene_id")
        .groupBy("program", *keys)
        .agg(F.sum(F.col("weight") * F.col("log1p_cpm")).alias("score"))
    )


def program_context(scores: DataFrame, keys: Sequence[str], types: Sequence[str], donors: Sequence[str]) -> DataFrame:
    """Relative top type per program and its stability when each donor is left out.

    Scores may be negative, so the top is simply the first declared maximum.
    """
    folds = comparisons(
        scores.withColumn("_v", F.round("score", 9)), keys, types, omission_sets(donors), F.col("_v")
    )
    names = F.array(*[F.lit(t) for t in types])
    best = folds.withColumn("_best", F.array_max("scores"))
    near = F.filter(
        F.transform("scores", lambda x, i: F.when(F.abs(x - F.col("_best")) <= TIE_TOLERANCE, i)), lambda i: i.isNotNull()
    )
    tops = best.select(*keys, "donor_set", F.get(names, F.get(near, F.lit(0))).alias("_top"))
    base = F.max(F.when(F.col("donor_set") == ALL_DONORS, F.col("_top")))
    fold = [F.max(F.when(F.col("donor_set") == d, F.col("_top"))).alias(f"_f{i}") for i, d in enumerate(donors)]
    wide = tops.groupBy(*keys).agg(base.alias("relative_top_type"), *fold)
    same = [F.coalesce(F.col(f"_f{i}") == F.col("relative_top_type"), F.lit(False)).cast("bigint") for i in range(len(donors))]
    return wide.select(
        *keys,
        "relative_top_type",
        sum(same[1:], same[0]).alias("agreeing_folds"),
        F.concat_ws(";", *[f"_f{i}" for i in range(len(donors))]).alias("fold_top_types"),
    )


def shared_pairs(pairs: DataFrame, first: DataFrame, second: DataFrame, min_controls: int) -> DataFrame:
    """Pairs whose panel gene and control exist in both studies, for panel genes keeping enough controls."""
    both = first.select("gene_id").distinct().join(second.select("gene_id").distinct(), "gene_id", "left_semi")
    common = pairs.join(both.withColumnRenamed("gene_id", "panel_gene"), "panel_gene", "left_semi").join(
        both.withColumnRenamed("gene_id", "control_gene"), "control_gene", "left_semi"
    )
    enough = common.groupBy("program", "panel_gene").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= min_controls)
    return common.join(enough.select("program", "panel_gene"), ["program", "panel_gene"], "left_semi")


def shared_coverage(pairs: DataFrame, shared: DataFrame, min_genes: int, min_fraction: float) -> DataFrame:
    """Panel genes before and after restricting to both studies, and eligibility."""
    before = pairs.groupBy("program").agg(F.countDistinct("panel_gene").alias("panel_genes"))
    after = shared.groupBy("program").agg(F.countDistinct("panel_gene").alias("_common"))
    common = F.coalesce("_common", F.lit(0))
    fraction = share(common, F.col("panel_genes"))
    return before.join(after, "program", "left").select(
        "program",
        "panel_genes",
        common.alias("common_panel_genes"),
        fraction.alias("common_fraction"),
        ((common >= min_genes) & (fraction >= min_fraction)).alias("eligible"),
    )
