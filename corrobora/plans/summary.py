"""Assembly of the evidence matrix, its screening flag, funnel and summary record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import rounded
from corrobora.operators import intervals as iv
from corrobora.operators import programs as pg
from corrobora.operators import ranking, screening
from corrobora.plans import bindings as b
from corrobora.plans.bindings import r, with_ctes
from corrobora.plans.context import BASE, FOLDS, SECOND, STABLE, concordance, tier_agreement, winner_sql
from corrobora.plans.intervals import EVENT_TYPES, POINTS, hits
from corrobora.plans.registry import query
from corrobora.plans.resampling import BRAND_LIST, DESIGN, TALLY, WORST, baseline, panels, worst
from corrobora.session import join_statistics, scratch_path, stored
from corrobora.sources.tables import load, write_summary

STRICT = (
    """strict_scores AS (SELECT gene_id, cell_type, avg(log1p_cpm) AS s FROM cube
  WHERE qc = 'strict' AND cell_type IN (SELECT cell_type FROM primary_types) GROUP BY 1, 2),
"""
    + winner_sql("strict_scores", "strict", "gene_id", 4)
)
LAYERS = ("any_link", "contact", "predicted", "eqtl", "overlap")
LABEL_OF = dict(zip(b.TYPES, EVENT_TYPES, strict=True))
"""The label of an open region that stands for each type."""

REGULATORY = POINTS + f""",
linked AS (SELECT l_suppkey AS variant_id, l_partkey AS gene_id, bool_or(l_discount > 0.09) AS contact, bool_or(l_tax > 0.07) AS predicted,
  bool_or(l_returnflag = 'R') AS eqtl FROM lineitem GROUP BY 1, 2),
opened AS (SELECT DISTINCT variant_id, label FROM hits),
layers AS (SELECT k.gene_id, count(*) FILTER (WHERE contact OR predicted OR eqtl) AS n_any_link, count(*) FILTER (WHERE contact) AS n_contact,
  count(*) FILTER (WHERE predicted) AS n_predicted, count(*) FILTER (WHERE eqtl) AS n_eqtl, count(*) FILTER (WHERE o.label IS NOT NULL) AS n_overlap
  FROM linked k LEFT JOIN base_all USING (gene_id) LEFT JOIN opened o ON o.variant_id = k.variant_id
    AND o.label = CASE top_type {' '.join(f"WHEN '{t}' THEN '{x}'" for t, x in LABEL_OF.items())} END GROUP BY 1)"""
MATRIX = """matrix0 AS (SELECT s.gene_id, s.gene_in_matrix, s.top_type, s.agreeing_folds, s.agreeing_folds = 5 AND s.evaluable_folds = 5 AS all_folds_agree,
  coalesce(t.status = 'unique' AND s.status = 'unique' AND t.top_type = s.top_type, false) AS same_top,
  min_agreement, held_out_agreement, coalesce(c.evaluable, false) AS evaluable, coalesce(c.concordant, false) AS concordant,
  coalesce(c.second_agreeing_folds, 0) AS second_agreeing_folds, coalesce(c.second_evaluable_folds, 0) AS second_evaluable_folds,
  """ + ", ".join(f"coalesce(n_{f}, 0) AS n_{f}" for f in LAYERS) + """, programs
  FROM stable s LEFT JOIN strict t USING (gene_id) LEFT JOIN worst USING (gene_id) LEFT JOIN concord c USING (gene_id)
  LEFT JOIN layers USING (gene_id)
  LEFT JOIN (SELECT p_partkey AS gene_id, p_brand AS programs FROM part WHERE p_brand IN (""" + BRAND_LIST + """)) pr USING (gene_id)),
matrix AS (SELECT *, coalesce(all_folds_agree AND same_top AND min_agreement >= 0.9 AND concordant AND second_agreeing_folds = 4
  AND second_evaluable_folds = 4, false) AS screening_flag FROM matrix0)"""
CTES = ("cells", "counts", "cube", "gene_sums", "genes", "primary_types", "types", "donors")
EXTRA = ",\n".join([DESIGN, BASE, FOLDS, STABLE, STRICT, SECOND, TALLY, WORST, REGULATORY, MATRIX])


CRITERIA = {
    "all_folds": "all_folds_agree",
    "same_tier_top": "same_top",
    "sampling": "min_agreement >= 0.9",
    "second_study": "concordant",
    "second_folds": "second_agreeing_folds = 4",
    "second_evaluable": "second_evaluable_folds = 4",
}


def regulatory_layers(spark: SparkSession, d: str) -> DataFrame:
    """Per gene the variants with a contact, a predicted target, a shared signal, any of them, and an open region of its type.

    Suppliers stand for variants, their lines for the source tables' gene links, and the labels of the intervals around the event
    of their number for open regions; the type is the gene's winner among all types.
    """
    lines = load(spark, d, "lineitem")
    linked = lines.groupBy(F.col("l_suppkey").cast("long").alias("variant_id"), F.col("l_partkey").alias("gene_id")).agg(
        F.bool_or(F.col("l_discount") > 0.09).alias("contact"),
        F.bool_or(F.col("l_tax") > 0.07).alias("predicted"),
        F.bool_or(F.col("l_returnflag") == "R").alias("eqtl"),
    )
    known = lines.select(F.col("l_suppkey").cast("long").alias("variant_id")).distinct()
    opened = iv.overlap_labels(hits(spark, d, known), "variant_id", "label", "types")
    labels = F.create_map(*[F.lit(x) for pair in LABEL_OF.items() for x in pair])
    context = baseline(b.cube(spark, d), b.TYPES).select("gene_id", labels[F.col("baseline_top_type")].alias("wanted"))
    pairs = join_statistics(linked, opened, ["variant_id"], "left").join(context, "gene_id", "left")
    flagged = pairs.withColumns(
        {
            "any_link": F.col("contact") | F.col("predicted") | F.col("eqtl"),
            "overlap": F.coalesce(F.array_contains("types", F.col("wanted")), F.lit(False)),
        }
    )
    return screening.layer_counts(flagged, "gene_id", LAYERS)


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """One row per listed gene with every layer beside the others, and the composite flag; made once a run."""
    return stored(spark, d, "evidence-matrix", lambda: _matrix(spark, d))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    cube = b.cube(spark, d)
    stable = ranking.stability(cube.filter("qc = 'primary'"), ["gene_id", "gene_in_matrix"], b.PRIMARY_TYPES, b.DONORS, F.col("log1p_cpm"))
    return screening.evidence_matrix(
        stable.select("gene_id", "gene_in_matrix", "top_type", "agreeing_folds", "all_folds_agree"),
        {
            "quality": tier_agreement(cube).select("gene_id", "same_top"),
            "sampling": worst(spark, d),
            "second": concordance(spark, d, cube).select("gene_id", "evaluable", "concordant", "second_agreeing_folds", "second_evaluable_folds"),
            "regulatory": regulatory_layers(spark, d),
            "programs": pg.membership_text(panels(spark, d)),
        },
        "gene_id",
        false_if_absent=["same_top", "evaluable", "concordant"],
        zero_if_absent=["second_agreeing_folds", "second_evaluable_folds", *[f"n_{f}" for f in LAYERS]],
        criteria=[F.expr(e) for e in CRITERIA.values()],
    )


@query("evidence_matrix", with_ctes("SELECT * FROM matrix", *CTES, extra=EXTRA))
def evidence_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@query(
    "descriptive_shortlist",
    with_ctes("SELECT gene_id, top_type, min_agreement FROM matrix WHERE screening_flag", *CTES, extra=EXTRA),
)
def descriptive_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).filter("screening_flag").select("gene_id", "top_type", "min_agreement")


@query(
    "screening_criteria",
    with_ctes(
        "SELECT gene_id, " + ", ".join(f"coalesce({e}, false) AS {n}" for n, e in CRITERIA.items()) + ", "
        + " + ".join(f"coalesce({e}, false)::INT" for e in CRITERIA.values()) + " AS n_met FROM matrix",
        *CTES, extra=EXTRA,
    ),
)
def screening_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Which of the six criteria every gene meets; the flag asks for all."""
    return screening.criteria_report(matrix(spark, d), "gene_id", {n: F.expr(e) for n, e in CRITERIA.items()})


STEPS = {
    "listed": "true",
    "mapped": "gene_in_matrix",
    "evaluable_in_both": "evaluable",
    "concordant": "concordant",
    "screening_flag": "screening_flag",
}


@query(
    "screening_funnel",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS step, '{n}' AS name, count(*) FILTER (WHERE {e}) AS genes FROM matrix" for i, (n, e) in enumerate(STEPS.items())
        ),
        *CTES, extra=EXTRA,
    ),
)
def screening_funnel(spark: SparkSession, d: str) -> DataFrame:
    return screening.funnel(matrix(spark, d), {n: F.expr(e) for n, e in STEPS.items()})


@query(
    "summary_record",
    with_ctes(
        f"""SELECT count(*) AS genes, count(*) FILTER (WHERE all_folds_agree) AS stable_genes,
  count(*) FILTER (WHERE top_type = '1-URGENT') AS first_type_genes, {r('avg(agreeing_folds)')} AS mean_agreeing_folds
FROM (SELECT *, agreeing_folds = 5 AND evaluable_folds = 5 AS all_folds_agree FROM stable)""",
        "cube", "primary_types", "donors", extra=f"{BASE},\n{FOLDS},\n{STABLE}",
    ),
)
def summary_record(spark: SparkSession, d: str) -> DataFrame:
    """A nested one-row record, written as JSON and read back with its declared schema."""
    stable = ranking.stability(
        b.cube(spark, d).filter("qc = 'primary'"), ["gene_id", "gene_in_matrix"], b.PRIMARY_TYPES, b.DONORS, F.col("log1p_cpm")
    )
    record = stable.agg(
        F.count(F.lit(1)).alias("genes"),
        F.struct(
            F.count_if("all_folds_agree").alias("stable_genes"),
            F.count_if(F.col("top_type") == b.TYPES[0]).alias("first_type_genes"),
            rounded(F.avg("agreeing_folds")).alias("mean_agreeing_folds"),
        ).alias("stability"),
    )
    path = scratch_path(spark, "summary")
    write_summary(record, path)
    schema = "genes bigint, stability struct<stable_genes: bigint, first_type_genes: bigint, mean_agreeing_folds: double>"
    return spark.read.schema(schema).json(path).select("genes", "stability.*")
