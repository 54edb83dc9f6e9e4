"""From counts to components: normalised values of the variable genes, decomposed without being made dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import rounded
from corrobora.operators import components as co
from corrobora.operators import counts as ops
from corrobora.plans import bindings as b
from corrobora.plans.bindings import r
from corrobora.plans.counts import HVG_SQL, variable_genes
from corrobora.plans.registry import query
from corrobora.session import stored

SEED = 20261006
SHOWN = 8


def selected_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    """Kept cells as sparse rows of the variable genes' normalised values."""
    genes = stored(spark, d, "variable-genes", lambda: variable_genes(spark, d).select("gene_id"))
    kept = b.qc_cells(spark, d).filter("qc_primary")
    return co.sparse_rows(ops.normalise(b.counts(spark, d), kept), kept, genes, "cell_id", "gene_id", "value")


@query("count_components")
def count_components(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the variance of the first components."""
    rows, names = selected_rows(spark, d)
    _, shares, _, _ = co.components(rows, len(names), SHOWN, SEED)
    table = [(i + 1, float(x)) for i, x in enumerate(shares)]
    return spark.createDataFrame(table, "component int, variance_ratio double").withColumn("variance_ratio", rounded(F.col("variance_ratio")))


_HEAD, _TAIL = HVG_SQL.rsplit("\nSELECT gene_id, CAST(n_batches", 1)
MODEL = f"""{_HEAD},
chosen AS (SELECT gene_id FROM (SELECT gene_id, CAST(n_batches{_TAIL})),
val AS (SELECT cell_id, gene_id, ln(1 + umi * 1e4 / total) AS v FROM counts JOIN kept USING (cell_id) WHERE gene_id IN (SELECT gene_id FROM chosen)),
n AS (SELECT count(*)::DOUBLE AS n FROM kept),
mu AS (SELECT gene_id, coalesce(sum(v), 0) / (SELECT n FROM n) AS m FROM chosen LEFT JOIN val USING (gene_id) GROUP BY 1)"""


@query(
    "count_component_power_sums",
    f"""{MODEL},
cross_ AS (SELECT a.gene_id AS i, b.gene_id AS j, sum(a.v * b.v) AS s FROM val a JOIN val b USING (cell_id) GROUP BY 1, 2),
c AS (SELECT x.gene_id AS i, y.gene_id AS j, coalesce(s, 0) - (SELECT n FROM n) * x.m * y.m AS c FROM mu x CROSS JOIN mu y LEFT JOIN cross_ ON i = x.gene_id AND j = y.gene_id),
t1 AS (SELECT sum(c) AS t FROM c WHERE i = j), t2 AS (SELECT sum(c * c) AS t FROM c),
t3 AS (SELECT sum(a.c * b.c * d.c) AS t FROM c a JOIN c b ON a.j = b.i JOIN c d ON b.j = d.i AND d.j = a.i)
SELECT (SELECT count(*) FROM mu) AS n_components, {r('1')} AS p1, {r('t2.t / (t1.t * t1.t)')} AS p2, {r('t3.t / (t1.t * t1.t * t1.t)')} AS p3 FROM t1, t2, t3""",
)
def count_component_power_sums(spark: SparkSession, d: str) -> DataFrame:
    """First three power sums of all components' shares of the variance."""
    rows, names = selected_rows(spark, d)
    _, shares, _, _ = co.components(rows, len(names), len(names), SEED)
    table = spark.createDataFrame([(float(x),) for x in shares], "x double")
    return table.agg(F.count(F.lit(1)).alias("n_components"), *[rounded(F.sum(F.pow("x", F.lit(k)))).alias(f"p{k}") for k in (1, 2, 3)])


@query(
    "count_component_scores",
    f"""{MODEL}
SELECT cell_id, count(v) AS n_values, {r('coalesce(sum(v * v - 2 * v * m), 0) + (SELECT sum(m * m) FROM mu)')} AS squared_norm
FROM kept LEFT JOIN val USING (cell_id) LEFT JOIN mu USING (gene_id) GROUP BY 1""",
)
def count_component_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per cell how many values it has and the squared length of its coordinates on all components."""
    rows, names = selected_rows(spark, d)
    directions, _, mean, _ = co.components(rows, len(names), len(names), SEED)
    sizes = rows.select("cell_id", F.size("at").cast("long").alias("n_values"))
    squared = F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x)
    found = co.scores(rows, "cell_id", directions, mean).select("cell_id", rounded(squared).alias("squared_norm"))
    return sizes.join(found, "cell_id")
