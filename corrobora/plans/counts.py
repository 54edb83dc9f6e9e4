"""Count-matrix queries: QC, normalisation, pseudobulk and descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import rounded
from corrobora.functions.strings import strip_cluster
from corrobora.operators import contracts, counts as ops
from corrobora.operators.ordering import rank_in_group
from corrobora.plans import bindings as b
from corrobora.plans.bindings import r, with_ctes
from corrobora.plans.registry import query
from corrobora.session import scratch_path
from corrobora.sources import tables, text
from corrobora.sources.tables import load


@query(
    "cell_qc_metrics",
    with_ctes(
        f"SELECT cell_id, total, n_genes, mt_total, {r('pct_mt')} AS pct_mt, qc_primary, qc_strict FROM cells",
        "cells",
    ),
)
def cell_qc_metrics(spark: SparkSession, d: str) -> DataFrame:
    return b.qc_cells(spark, d).select(
        "cell_id", "total", "n_genes", "mt_total", rounded(F.col("pct_mt")).alias("pct_mt"), "qc_primary", "qc_strict"
    )


@query(
    "qc_by_donor",
    with_ctes(
        "SELECT donor, count(*) FILTER (WHERE qc_primary) AS primary_cells, "
        "count(*) FILTER (WHERE qc_strict) AS strict_cells, count(*) AS input_cells FROM cells GROUP BY donor",
        "cells",
    ),
)
def qc_by_donor(spark: SparkSession, d: str) -> DataFrame:
    return ops.passed_by_donor(b.qc_cells(spark, d))


@query(
    "aligned_cell_metadata",
    with_ctes(
        "SELECT cell_id, donor, library, cell_type, total FROM labels0 JOIN metrics USING (cell_id)", "labels0", "metrics"
    ),
)
def aligned_cell_metadata(spark: SparkSession, d: str) -> DataFrame:
    metrics = ops.cell_metrics(b.counts(spark, d), b.genes(spark, d))
    return ops.attach_metadata(metrics, b.cell_labels(spark, d)).select(
        "cell_id", "donor", "library", "cell_type", "total"
    )


@query(
    "normalised_counts",
    with_ctes(
        f"SELECT cell_id, gene_id, umi, {r('ln(1 + umi * 1e4 / total)')} AS value "
        "FROM counts JOIN cells USING (cell_id) WHERE qc_primary",
        "counts",
        "cells",
    ),
)
def normalised_counts(spark: SparkSession, d: str) -> DataFrame:
    out = ops.normalise(b.counts(spark, d), b.qc_cells(spark, d).filter("qc_primary"))
    return out.withColumn("value", rounded(F.col("value")))


@query(
    "gene_detection",
    with_ctes(
        "SELECT g.gene_id, count(c.cell_id) AS detected_cells, count(c.cell_id) >= 3 AND NOT any_value(is_mt) AS model_eligible "
        "FROM genes g LEFT JOIN (SELECT gene_id, cell_id FROM counts JOIN cells USING (cell_id) WHERE qc_primary AND umi > 0) c "
        "ON c.gene_id = g.gene_id GROUP BY g.gene_id",
        "genes",
        "counts",
        "cells",
    ),
)
def gene_detection(spark: SparkSession, d: str) -> DataFrame:
    kept = b.qc_cells(spark, d).filter("qc_primary")
    return ops.detected_cells(b.counts(spark, d), kept, b.genes(spark, d), 3)


HVG_SQL = with_ctes(
    f"""SELECT gene_id, CAST(n_batches AS BIGINT) AS n_batches, {r('mean_norm_dispersion')} AS mean_norm_dispersion FROM (
  SELECT gene_id, avg(nd) AS mean_norm_dispersion, count(*) FILTER (WHERE rk <= 200) AS n_batches
  FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY round(nd, 9) DESC, gene_id) AS rk FROM scored)
  GROUP BY gene_id)
ORDER BY n_batches DESC, round(mean_norm_dispersion, 9) DESC, gene_id LIMIT 200""",
    "genes",
    "counts",
    "cells",
    extra="""kept AS (SELECT * FROM cells WHERE qc_primary),
eligible AS (SELECT gene_id FROM counts JOIN kept USING (cell_id) JOIN genes USING (gene_id)
  WHERE umi > 0 AND NOT is_mt GROUP BY gene_id HAVING count(*) >= 3),
x AS (SELECT library, gene_id, exp(ln(1 + umi * 1e4 / total)) - 1 AS v FROM counts JOIN kept USING (cell_id)
  WHERE gene_id IN (SELECT gene_id FROM eligible)),
size AS (SELECT library, count(*)::DOUBLE AS n FROM kept GROUP BY 1),
moments AS (SELECT library, gene_id, sum(v) / any_value(n) AS m,
  (sum(v * v) - any_value(n) * (sum(v) / any_value(n)) * (sum(v) / any_value(n))) / (any_value(n) - 1) AS s2
  FROM x JOIN size USING (library) GROUP BY 1, 2),
stats AS (SELECT library, gene_id, ln(1 + m) AS lm, ln(s2 / m) AS ld FROM moments WHERE s2 > 0),
span AS (SELECT library, min(lm) AS lo, max(lm) AS hi FROM stats GROUP BY 1),
binned AS (SELECT s.*, least(19, coalesce(floor((lm - lo) / nullif((hi - lo) / 20.0, 0)), 0))::INTEGER AS bin
  FROM stats s JOIN span USING (library)),
binstats AS (SELECT library, bin, avg(ld) AS mu, stddev_samp(ld) AS sd, count(*) AS n FROM binned GROUP BY 1, 2),
scored AS (SELECT b.library, gene_id, CASE WHEN n = 1 OR sd = 0 THEN 1.0 ELSE (ld - mu) / sd END AS nd
  FROM binned b JOIN binstats USING (library, bin))""",
)


@query("variable_genes", HVG_SQL)
def variable_genes(spark: SparkSession, d: str) -> DataFrame:
    kept = b.qc_cells(spark, d).filter("qc_primary")
    counts = b.counts(spark, d)
    eligible = ops.detected_cells(counts, kept, b.genes(spark, d), 3).filter("model_eligible")
    out = ops.variable_genes(ops.normalise(counts, kept, carry=["library"]), kept, eligible, n_top=200)
    return out.select("gene_id", "n_batches", rounded(F.col("mean_norm_dispersion")).alias("mean_norm_dispersion"))


CUBE_COLUMNS = (
    f"qc, donor, cell_type, gene_id, n_cells, sum_all_umis, sum_gene_umis, {r('cpm', 4)} AS cpm, "
    f"{r('log1p_cpm')} AS log1p_cpm, {r('mean_log1p_cp10k')} AS mean_log1p_cp10k, "
    f"{r('pct_detected')} AS pct_detected, gene_in_matrix, eligible, status"
)


@query("pseudobulk_expression", with_ctes(f"SELECT {CUBE_COLUMNS} FROM cube", "cube"))
def pseudobulk_expression(spark: SparkSession, d: str) -> DataFrame:
    return (
        b.cube(spark, d)
        .withColumn("cpm", rounded(F.col("cpm"), 4))
        .withColumn("log1p_cpm", rounded(F.col("log1p_cpm")))
        .withColumn("mean_log1p_cp10k", rounded(F.col("mean_log1p_cp10k")))
        .withColumn("pct_detected", rounded(F.col("pct_detected")))
    )


BALANCED = """balanced AS (SELECT qc, cell_type, gene_id, count(*) FILTER (WHERE eligible) AS eligible_donors,
  CAST(sum(n_cells) AS BIGINT) AS total_cells, avg(log1p_cpm) FILTER (WHERE eligible) AS mean_log1p_cpm,
  avg(mean_log1p_cp10k) FILTER (WHERE eligible) AS mean_log1p_cp10k,
  avg(pct_detected) FILTER (WHERE eligible) AS mean_pct_detected FROM cube GROUP BY 1, 2, 3)"""


@query(
    "donor_balanced_expression",
    with_ctes(
        f"SELECT qc, cell_type, gene_id, eligible_donors, total_cells, {r('mean_log1p_cpm')} AS mean_log1p_cpm, "
        f"{r('mean_log1p_cp10k')} AS mean_log1p_cp10k, {r('mean_pct_detected')} AS mean_pct_detected FROM balanced",
        "cube",
        extra=BALANCED,
    ),
)
def donor_balanced_expression(spark: SparkSession, d: str) -> DataFrame:
    out = ops.balanced_means(b.cube(spark, d))
    return out.select(
        "qc",
        "cell_type",
        "gene_id",
        "eligible_donors",
        "total_cells",
        *[rounded(F.col(c)).alias(c) for c in ("mean_log1p_cpm", "mean_log1p_cp10k", "mean_pct_detected")],
    )


@query(
    "relative_expression",
    with_ctes(
        f"""SELECT gene_id, cell_type, {r('v / nullif(max(v) OVER (PARTITION BY gene_id), 0)')} AS relative_to_max
FROM (SELECT gene_id, cell_type, CASE WHEN eligible_donors = 5 THEN mean_log1p_cpm END AS v FROM balanced WHERE qc = 'primary')""",
        "cube",
        extra=BALANCED,
    ),
)
def relative_expression(spark: SparkSession, d: str) -> DataFrame:
    means = ops.balanced_means(b.cube(spark, d).filter("qc = 'primary'"))
    out = ops.relative_to_maximum(means, len(b.DONORS))
    return out.withColumn("relative_to_max", rounded(F.col("relative_to_max")))


@query(
    "types_shared_by_all_donors",
    with_ctes(
        """SELECT qc, cell_type, min(coalesce(n_cells, 0)) AS smallest_donor_cells
FROM (VALUES ('primary'), ('strict')) q(qc) CROSS JOIN (SELECT donor FROM donors) CROSS JOIN (SELECT cell_type FROM types)
LEFT JOIN totals USING (qc, donor, cell_type) GROUP BY 1, 2 HAVING min(coalesce(n_cells, 0)) >= 100""",
        "donors",
        "types",
        "totals",
    ),
)
def types_shared_by_all_donors(spark: SparkSession, d: str) -> DataFrame:
    return ops.shared_types(ops.group_totals(b.qc_cells(spark, d)), b.DONORS, b.TYPES, 100)


@query(
    "donor_type_eligibility",
    with_ctes(
        """SELECT qc, donor, cell_type, coalesce(n_cells, 0) AS n_cells, coalesce(n_cells, 0) >= 20 AS eligible_group
FROM (VALUES ('primary'), ('strict')) q(qc) CROSS JOIN (SELECT donor FROM donors) CROSS JOIN (SELECT cell_type FROM types)
LEFT JOIN totals USING (qc, donor, cell_type)""",
        "donors",
        "types",
        "totals",
    ),
)
def donor_type_eligibility(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(q,) for q in ops.TIERS], "qc string")
    frame = ops.scaffold(keys, donor=b.DONORS, cell_type=b.TYPES)
    n = F.coalesce("n_cells", F.lit(0))
    return frame.join(ops.group_totals(b.qc_cells(spark, d)), ["qc", "donor", "cell_type"], "left").select(
        "qc", "donor", "cell_type", n.alias("n_cells"), (n >= b.MIN_CELLS).alias("eligible_group")
    )


@query(
    "type_by_donor_contingency",
    with_ctes(
        "SELECT cell_type, "
        + ", ".join(f"count(*) FILTER (WHERE donor = '{x}') AS \"n_{x}\"" for x in b.DONORS)
        + " FROM labels0 GROUP BY cell_type",
        "labels0",
    ),
)
def type_by_donor_contingency(spark: SparkSession, d: str) -> DataFrame:
    return ops.contingency(b.cell_labels(spark, d), "cell_type", "donor", b.DONORS)


@query(
    "panel_statistics",
    with_ctes(
        f"""SELECT cell_type, l.gene_id, n_cells,
  CASE WHEN gene_in_matrix THEN {r('coalesce(x, 0) / n_cells')} END AS mean_value,
  CASE WHEN gene_in_matrix THEN {r('100.0::DOUBLE * coalesce(k, 0) / n_cells')} END AS pct_detected, gene_in_matrix
FROM listed l CROSS JOIN (SELECT cell_type, count(*) AS n_cells FROM cells WHERE qc_primary GROUP BY 1) s
LEFT JOIN (SELECT cell_type, gene_id, sum(ln(1 + umi * 1e4 / total)) AS x, count(*) AS k FROM counts JOIN cells USING (cell_id)
  WHERE qc_primary GROUP BY 1, 2) v USING (cell_type, gene_id)""",
        "listed",
        "counts",
        "cells",
    ),
)
def panel_statistics(spark: SparkSession, d: str) -> DataFrame:
    kept = b.qc_cells(spark, d).filter("qc_primary")
    counts = b.counts(spark, d)
    matrix = load(spark, d, "lineitem").select(F.col("l_partkey").alias("gene_id"))
    out = ops.panel_statistics(
        ops.normalise(counts, kept), kept, "cell_type", b.TYPES, b.listed_genes(spark, d).select("gene_id"), matrix
    )
    return out.select(
        "cell_type",
        "gene_id",
        "n_cells",
        rounded(F.col("mean_value")).alias("mean_value"),
        rounded(F.col("pct_detected")).alias("pct_detected"),
        "gene_in_matrix",
    )


@query(
    "donor_details",
    with_ctes(
        "SELECT donor, count(*) AS n_cells, min(segment) AS segment, min(segment) = max(segment) AS segment_constant, "
        "count(DISTINCT sample) AS n_samples FROM labels0 GROUP BY donor",
        "labels0",
    ),
)
def donor_details(spark: SparkSession, d: str) -> DataFrame:
    return ops.entity_details(b.cell_labels(spark, d), "donor", ["segment"], "sample")


@query(
    "sparsity_summary",
    with_ctes(
        """SELECT gene_id, CAST(sum(u) AS BIGINT) AS assigned_umis, count(*) FILTER (WHERE u > 0) AS donors_detected,
  coalesce(sum(u) < 50, false) AS sparse_flag
FROM (SELECT gene_id, donor, sum(sum_gene_umis) AS u FROM cube WHERE qc = 'primary' GROUP BY 1, 2) GROUP BY gene_id""",
        "cube",
    ),
)
def sparsity_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.sparsity(b.cube(spark, d))


ANNOTATION_SQL = with_ctes(
    f"""SELECT nation, n_cells, dominant_label, {r('dominant_n / n_cells')} AS dominant_fraction,
  coalesce(best_panel, 'Unassigned') AS provisional_panel, {r('best_z')} AS provisional_score,
  coalesce(best_panel, 'Unassigned') = dominant_label AS panel_matches, {r('donor_n / n_cells')} AS largest_donor_fraction
FROM dominant JOIN donor_share USING (nation) LEFT JOIN best USING (nation)""",
    "genes",
    "counts",
    "cells",
    "types",
    extra="""kept AS (SELECT * FROM cells WHERE qc_primary),
size AS (SELECT nation, count(*) AS n_cells FROM kept GROUP BY 1),
panel AS (SELECT gene_id, cell_type AS panel FROM genes JOIN types ON ord = strpos('EMPSL', substr(panel, 1, 1)) - 1
  WHERE substr(panel, 1, 1) IN ('E', 'M', 'P', 'S', 'L')),
v AS (SELECT nation, gene_id, sum(ln(1 + umi * 1e4 / total)) AS x FROM counts JOIN kept USING (cell_id) GROUP BY 1, 2),
stats AS (SELECT nation, gene_id, panel, coalesce(x, 0) / n_cells AS m FROM panel CROSS JOIN size LEFT JOIN v USING (nation, gene_id)),
z AS (SELECT nation, panel, (m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0) AS z FROM stats WINDOW w AS (PARTITION BY gene_id)),
score AS (SELECT nation, panel, avg(z) AS s FROM z GROUP BY 1, 2 HAVING avg(z) IS NOT NULL),
best AS (SELECT nation, panel AS best_panel, max(s) OVER (PARTITION BY nation) AS best_z FROM score JOIN types ON panel = cell_type
  QUALIFY row_number() OVER (PARTITION BY nation ORDER BY round(s, 9) DESC, ord) = 1),
by_label AS (SELECT nation, cell_type, count(*) AS n FROM kept GROUP BY 1, 2),
dominant AS (SELECT nation, cell_type AS dominant_label, n::DOUBLE AS dominant_n, CAST(sum(n) OVER (PARTITION BY nation) AS BIGINT) AS n_cells
  FROM by_label JOIN types USING (cell_type) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, ord) = 1),
donor_share AS (SELECT nation, max(n)::DOUBLE AS donor_n FROM (SELECT nation, sample, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1)""",
)


@query("cluster_annotation_audit", ANNOTATION_SQL)
def cluster_annotation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Clusters are the 25 nations, known labels the order priorities, panels sets of parts."""
    kept = b.qc_cells(spark, d).filter("qc_primary")
    counts = b.counts(spark, d)
    to_type = F.create_map(*[F.lit(x) for pair in zip("EMPSL", b.TYPES) for x in pair])
    panel = (
        b.genes(spark, d)
        .select("gene_id", F.try_element_at(to_type, F.substring("panel", 1, 1)).alias("panel"))
        .filter("panel IS NOT NULL")
    )
    stats = ops.panel_statistics(
        ops.normalise(counts, kept), kept.withColumn("nation", F.col("nation").cast("string")), "nation",
        [str(i) for i in range(25)], panel, b.genes(spark, d),
    )
    out = ops.cluster_annotation(
        kept.withColumn("nation", F.col("nation").cast("string")), stats, "nation", "cell_type", b.TYPES, "sample"
    )
    return out.select(
        F.col("nation").cast("int").alias("nation"),
        "n_cells",
        "dominant_label",
        rounded(F.col("dominant_fraction")).alias("dominant_fraction"),
        "provisional_panel",
        rounded(F.col("provisional_score")).alias("provisional_score"),
        "panel_matches",
        rounded(F.col("largest_donor_fraction")).alias("largest_donor_fraction"),
    )


@query(
    "wide_count_text_scan",
    "SELECT 'n' || c_nationkey AS cell_id, 'g' || l_partkey AS gene_id, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS umi "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2",
)
def wide_count_text_scan(spark: SparkSession, d: str) -> DataFrame:
    return wide_text(spark, d, [])[0]


@query(
    "wide_count_text_violations",
    """SELECT 'bad_count' AS gene_id, 'count' AS problem UNION ALL SELECT 'bad_width', 'width'
UNION ALL SELECT 'g' || min(l_partkey), 'repeated_gene' FROM lineitem""",
)
def wide_count_text_violations(spark: SparkSession, d: str) -> DataFrame:
    """The same text with a bad count, a short line and a repeated gene in it."""
    least = load(spark, d, "lineitem").agg(F.min("l_partkey").alias("g")).first()["g"]
    zeros = ",0" * 24
    return wide_text(spark, d, [f"bad_count,x{zeros}", f"bad_width{zeros}", f"g{least},1{zeros}"])[1]


def wide_text(spark: SparkSession, d: str, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Write gene rows with one column per nation as text without a corner cell, then scan them."""
    nations = [str(i) for i in range(25)]
    wide = (
        load(spark, d, "lineitem")
        .join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("l_partkey")
        .agg(*[F.sum(F.when(F.col("c_nationkey") == int(n), F.col("l_quantity").cast("int")).otherwise(0)).alias(n) for n in nations])
    )
    lines = wide.select(F.concat_ws(",", F.concat(F.lit("g"), F.col("l_partkey")), *[F.col(n) for n in nations]).alias("value"))
    head = spark.createDataFrame([("," + ",".join(f"n{n}" for n in nations),)], "value string")
    path = scratch_path(spark, "wide-counts")
    extra = spark.createDataFrame([(x,) for x in more], "value string")
    head.union(lines).union(extra).write.text(path)
    return text.read_wide_counts(spark, path)


@query(
    "triplet_count_scan",
    with_ctes("SELECT cell_id, gene_id, umi FROM counts", "counts"),
)
def triplet_count_scan(spark: SparkSession, d: str) -> DataFrame:
    entries, _, genes, cells = triplet_text(spark, d, [])
    return text.label_triplets(entries, genes, cells)


@query(
    "triplet_count_check",
    with_ctes(
        """SELECT count(*) + 4 AS n_entries, (SELECT count(*) FROM part) AS declared_rows, count(DISTINCT cell_id) AS declared_cols,
  count(*) AS declared_entries, 3::BIGINT AS n_invalid, 2::BIGINT AS n_repeated, false AS consistent FROM counts""",
        "counts",
    ),
)
def triplet_count_check(spark: SparkSession, d: str) -> DataFrame:
    """The check of the same text with bad ordinals, a bad value and a repeated place in it."""
    least = b.counts(spark, d).agg(F.min(F.struct("gene_id", "cell_id")).alias("x")).select("x.*")
    return triplet_text(spark, d, ["zz 2 7", "0 1 1", "1 99999999999 3"], least)[1]


def triplet_text(
    spark: SparkSession, d: str, more: list[str], repeat: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Write the counts as coordinate text with ordinals, then scan them: entries, check, genes and cells."""
    counts = b.counts(spark, d)
    genes = rank_in_group(b.genes(spark, d).select("gene_id"), [], [F.col("gene_id")], "ordinal")
    cells = rank_in_group(counts.select("cell_id").distinct(), [], [F.col("cell_id")], "ordinal")
    rows = counts.join(genes.withColumnRenamed("ordinal", "i"), "gene_id").join(cells.withColumnRenamed("ordinal", "j"), "cell_id")
    path, dims = scratch_path(spark, "triplets"), scratch_path(spark, "triplet-size")
    lines = rows.select(F.concat_ws(" ", "i", "j", "umi").alias("value"))
    if repeat is not None:
        again = rows.join(repeat, ["gene_id", "cell_id"]).select(F.concat_ws(" ", "i", "j", F.lit(1)).alias("value"))
        lines = lines.union(again)
    lines.union(spark.createDataFrame([(x,) for x in more], "value string")).write.text(path)
    sizes = (
        genes.select(F.lit("g").alias("part"))
        .unionByName(cells.select(F.lit("c").alias("part")))
        .unionByName(counts.select(F.lit("n").alias("part")))
        .agg(*[F.count_if(F.col("part") == x).alias(x) for x in "gcn"])
    )
    sizes.select(F.concat_ws(" ", "g", "c", "n").alias("value")).write.text(dims)
    entries, check = text.read_triplets(spark, path, dims)
    return entries, check, genes, cells


@query(
    "saved_cube_reread",
    with_ctes(
        "SELECT donor, cell_type, gene_id, n_cells, sum_gene_umis, sum_all_umis FROM cube WHERE qc = 'strict'", "cube"
    ),
)
def saved_cube_reread(spark: SparkSession, d: str) -> DataFrame:
    """Save the whole cube by study and tier, then read one tier back by partition."""
    path = scratch_path(spark, "cube")
    columns = "qc", "donor", "cell_type", "gene_id", "n_cells", "sum_gene_umis", "sum_all_umis"
    tables.write_pseudobulk(b.cube(spark, d).select(F.lit("first").alias("study"), *columns), path)
    schema = (
        "donor string, cell_type string, gene_id bigint, n_cells bigint, sum_gene_umis bigint, "
        "sum_all_umis bigint, study string, qc string"
    )
    return tables.read_pseudobulk(spark, path, "first", "strict", schema).drop("study", "qc")


@query(
    "cluster_label_recode",
    "SELECT o_orderpriority AS cell_type, count(*) AS n_cells, count(DISTINCT c_nationkey) AS n_clusters "
    "FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1",
)
def cluster_label_recode(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a cluster suffix are stripped and recoded; the label outside the map is left out."""
    cells = b.cell_labels(spark, d).withColumn("label", F.concat("cell_type", F.lit(" C"), F.col("nation").cast("string")))
    broad = cells.withColumn("broad", strip_cluster(F.col("label")))
    coded, _ = contracts.recode(broad, "broad", {t: t for t in b.PRIMARY_TYPES}, "known_type")
    return coded.groupBy(F.col("known_type").alias("cell_type")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("label").alias("n_clusters")
    )


@query(
    "unknown_label_report",
    "SELECT o_orderpriority AS cell_type, count(*) AS n_rows FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' GROUP BY 1",
)
def unknown_label_report(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_orderpriority").alias("cell_type"))
    return contracts.recode(orders, "cell_type", {t: t for t in b.PRIMARY_TYPES}, "known_type")[1]


@query(
    "candidate_mapping_audit",
    with_ctes(
        "SELECT gene_id, gene_in_matrix, CASE WHEN gene_in_matrix THEN 'exact_symbol' ELSE 'missing_symbol' END AS mapping_status, "
        "'exact key; absent keys stay missing' AS mapping_policy FROM listed",
        "listed",
    ),
)
def candidate_mapping_audit(spark: SparkSession, d: str) -> DataFrame:
    return b.listed_genes(spark, d)
