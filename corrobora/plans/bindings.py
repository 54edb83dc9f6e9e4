"""How the driver's tables play the roles of the data model, in Spark and in SQL.

=====================  ==========================================================
role                   table
=====================  ==========================================================
counts                 ``lineitem``: order = cell, part = gene, quantity = count
cells                  ``orders`` with the customer's region as donor
genes                  ``part``; one brand stands for the mitochondrial genes
association records    ``lineitem`` by return flag (method) and supplier (locus)
summary statistics     ``lineitem`` means per supplier (region) and part (variant)
points, intervals      ``events``: second of ``ts``; ``value`` minutes long
embeddings             ``embeddings``
=====================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import nudge
from corrobora.operators import contracts, counts as ops
from corrobora.session import parts_for, stored
from corrobora.sources.tables import load

DONORS = ["D0", "D1", "D2", "D3", "D4"]
TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIMARY_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
LIBRARIES = ["F", "O", "P"]
PANELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIMARY_QC = (2, 40.0)
STRICT_QC = (4, 20.0)
MIN_CELLS = 20


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per cell and gene, aggregated from the lines once a run."""

    def build() -> DataFrame:
        # hardly any lines share cell and gene, so adding them up before they move would only hold them all in memory
        lines = load(spark, d, "lineitem")
        units = lines.select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").cast("int").alias("n"))
        dealt = units.repartition(parts_for(spark, lines.count()), "cell_id", "gene_id")
        return dealt.groupBy("cell_id", "gene_id").agg(F.sum("n").alias("umi"))

    return stored(spark, d, "counts", build)


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("o_custkey").alias("sample"),
        F.col("o_orderstatus").alias("library"),
        F.col("o_orderpriority").alias("cell_type"),
    )
    donors = (
        load(spark, d, "customer")
        .join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("sample"),
            F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("donor"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
        )
    )
    return orders.join(donors, "sample")


def genes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.col("p_name").alias("symbol"),
        (F.col("p_brand") == "Brand#1").alias("is_mt"),
        F.col("p_type").alias("panel"),
    )


def listed_genes(spark: SparkSession, d: str) -> DataFrame:
    """Every part, and one key per supplier that no count uses."""
    absent = load(spark, d, "supplier").select((-F.col("s_suppkey") - F.lit(1)).alias("gene_id"))
    listed = genes(spark, d).select("gene_id").unionByName(absent)
    audit = contracts.mapping_audit(
        listed,
        counts(spark, d).select("gene_id"),
        "gene_id",
        "exact key; absent keys stay missing",
    )
    return audit.withColumnRenamed("exact_match", "gene_in_matrix")


def qc_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their metrics and both QC tiers, made once a run."""

    def build() -> DataFrame:
        metrics = ops.cell_metrics(counts(spark, d), genes(spark, d))
        return ops.quality_flags(cell_labels(spark, d).join(metrics, "cell_id"), PRIMARY_QC, STRICT_QC)

    return stored(spark, d, "cells", build)


def cube(spark: SparkSession, d: str) -> DataFrame:
    """The pseudobulk cube of both tiers; its sums are made once a run, and readers get only the tier and columns they use."""

    def build() -> DataFrame:
        sums = ops.gene_sums(counts(spark, d), qc_cells(spark, d))
        return ops.cube_frame(sums, listed_genes(spark, d), DONORS, TYPES)

    frame = stored(spark, d, "cube", build)
    totals = stored(spark, d, "group-totals", lambda: ops.group_totals(qc_cells(spark, d)))
    return ops.cube_values(ops.tiers_apart(frame), totals, DONORS, TYPES, MIN_CELLS)


def values(items: list[str], table: str, column: str) -> str:
    """SQL literal table of a declared list with its order."""
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(items))
    return f"{table} AS (SELECT * FROM (VALUES {rows}) v({column}, ord))"


def r(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "genes": (
        "genes AS (SELECT p_partkey AS gene_id, p_name AS symbol, p_brand = 'Brand#1' AS is_mt, p_type AS panel FROM part)",
        (),
    ),
    "counts": (
        "counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, "
        "CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS umi FROM lineitem GROUP BY 1, 2)",
        (),
    ),
    "labels0": (
        "labels0 AS (SELECT o_orderkey AS cell_id, o_custkey AS sample, o_orderstatus AS library, "
        "o_orderpriority AS cell_type, 'D' || n_regionkey AS donor, c_nationkey AS nation, c_mktsegment AS segment "
        "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)",
        (),
    ),
    "metrics": (
        "metrics AS (SELECT cell_id, CAST(sum(umi) AS BIGINT) AS total, count(*) AS n_genes, "
        "CAST(sum(CASE WHEN is_mt THEN umi ELSE 0 END) AS BIGINT) AS mt_total, "
        "100.0::DOUBLE * sum(CASE WHEN is_mt THEN umi ELSE 0 END) / sum(umi) AS pct_mt "
        "FROM counts JOIN genes USING (gene_id) WHERE umi > 0 GROUP BY 1)",
        ("counts", "genes"),
    ),
    "cells": (
        "cells AS (SELECT *, n_genes >= 2 AND pct_mt < 40 AS qc_primary, "
        "n_genes >= 2 AND pct_mt < 40 AND n_genes >= 4 AND pct_mt < 20 AS qc_strict "
        "FROM labels0 JOIN metrics USING (cell_id))",
        ("labels0", "metrics"),
    ),
    "tiered": (
        "tiered AS (SELECT 'primary' AS qc, * FROM cells WHERE qc_primary "
        "UNION ALL SELECT 'strict' AS qc, * FROM cells WHERE qc_strict)",
        ("cells",),
    ),
    "totals": (
        "totals AS (SELECT qc, donor, cell_type, count(*) AS n_cells, CAST(sum(total) AS BIGINT) AS sum_all "
        "FROM tiered GROUP BY 1, 2, 3)",
        ("tiered",),
    ),
    "gene_sums": (
        "gene_sums AS (SELECT qc, donor, cell_type, gene_id, CAST(sum(umi) AS BIGINT) AS sum_gene, "
        "count(*) AS n_detected, sum(ln(1 + umi * 1e4 / total)) AS sum_value "
        "FROM tiered JOIN counts USING (cell_id) WHERE umi > 0 GROUP BY 1, 2, 3, 4)",
        ("tiered", "counts"),
    ),
    "listed": (
        "listed AS (SELECT gene_id, gene_id IN (SELECT l_partkey FROM lineitem) AS gene_in_matrix "
        "FROM (SELECT p_partkey AS gene_id FROM part UNION ALL SELECT -s_suppkey - 1 FROM supplier))",
        (),
    ),
    "donors": (values(DONORS, "donors", "donor"), ()),
    "types": (values(TYPES, "types", "cell_type"), ()),
    "primary_types": (values(PRIMARY_TYPES, "primary_types", "cell_type"), ()),
    "cube": (
        """cube AS (
  SELECT qc, donor, cell_type, gene_id, coalesce(n_cells, 0) AS n_cells, coalesce(sum_all, 0) AS sum_all_umis,
    CASE WHEN n_cells > 0 AND gene_in_matrix THEN coalesce(sum_gene, 0) END AS sum_gene_umis,
    CASE WHEN n_cells > 0 AND gene_in_matrix THEN 1e6 * coalesce(sum_gene, 0) / sum_all END AS cpm,
    CASE WHEN n_cells > 0 AND gene_in_matrix THEN ln(1 + 1e6 * coalesce(sum_gene, 0) / sum_all) END AS log1p_cpm,
    CASE WHEN n_cells > 0 AND gene_in_matrix THEN coalesce(sum_value, 0) / n_cells END AS mean_log1p_cp10k,
    CASE WHEN n_cells > 0 AND gene_in_matrix THEN 100.0::DOUBLE * coalesce(n_detected, 0) / n_cells END AS pct_detected,
    gene_in_matrix,
    gene_in_matrix AND coalesce(n_cells, 0) >= 20 AS eligible,
    CASE WHEN NOT gene_in_matrix THEN 'gene_not_in_matrix' WHEN coalesce(n_cells, 0) = 0 THEN 'no_cells'
         WHEN n_cells < 20 THEN 'below_minimum' ELSE 'eligible' END AS status
  FROM listed CROSS JOIN (VALUES ('primary'), ('strict')) q(qc)
  CROSS JOIN (SELECT donor FROM donors) CROSS JOIN (SELECT cell_type FROM types)
  LEFT JOIN totals USING (qc, donor, cell_type) LEFT JOIN gene_sums USING (qc, donor, cell_type, gene_id))""",
        ("listed", "donors", "types", "totals", "gene_sums"),
    ),
}


def with_ctes(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` preceded by the named fragments and all they need, then any extra ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][1]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    parts = [CTES[n][0] for n in order] + ([extra] if extra else [])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body
