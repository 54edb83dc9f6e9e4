"""Sparse entity-by-feature counts in long form ``(cell_id, gene_id, umi)``; an absent row is a zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.numeric import cpm, depth_normalised, share
from corrobora.session import join_statistics, cut_lineage

TIERS = ("primary", "strict")
SUM_COLUMNS = {"_g": "sum_gene", "_d": "n_detected", "_x": "sum_value"}


def attach_metadata(cells: DataFrame, *tables: DataFrame, key: str = "cell_id") -> DataFrame:
    """Exact-id metadata alignment of several tables; the order column of the first survives."""
    out = cells
    for t in tables:
        out = out.join(t, key)
    return out


def mark_prefix(genes: DataFrame, column: str, prefix: str, name: str = "is_mt") -> DataFrame:
    """Flag features by an exact prefix."""
    return genes.withColumn(name, F.col(column).startswith(prefix))


def cell_metrics(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Per-cell totals, detected features and the share from flagged features."""
    flagged = counts.filter(F.col("umi") > 0).join(genes.select("gene_id", "is_mt"), "gene_id")
    return flagged.groupBy("cell_id").agg(
        F.sum("umi").alias("total"),
        F.count(F.lit(1)).alias("n_genes"),
        F.sum(F.when(F.col("is_mt"), F.col("umi")).otherwise(F.lit(0))).alias("mt_total"),
    ).withColumn("pct_mt", share(F.col("mt_total") * F.lit(100.0), F.col("total")))


def quality_flags(cells: DataFrame, primary: tuple[int, float], strict: tuple[int, float]) -> DataFrame:
    """Two QC tiers ``n_genes >= a and pct_mt < b``; strict is judged on cells kept by primary."""
    rule = lambda a, b: F.coalesce((F.col("n_genes") >= a) & (F.col("pct_mt") < b), F.lit(False))
    return cells.withColumn("qc_primary", rule(*primary)).withColumn(
        "qc_strict", F.col("qc_primary") & rule(*strict)
    )


def passed_by_donor(cells: DataFrame) -> DataFrame:
    """Input and passing cells per donor."""
    return cells.groupBy("donor").agg(
        F.count_if("qc_primary").alias("primary_cells"),
        F.count_if("qc_strict").alias("strict_cells"),
        F.count(F.lit(1)).alias("input_cells"),
    )


def normalise(counts: DataFrame, cells: DataFrame, target: float = 1e4, carry: Sequence[str] = ()) -> DataFrame:
    """Depth-normalised ``log1p`` value for every stored count of the given cells, with the cells' columns to ``carry``."""
    return counts.join(cells.select("cell_id", "total", *carry), "cell_id").select(
        "cell_id", "gene_id", "umi", depth_normalised(F.col("umi"), F.col("total"), target).alias("value"), *carry
    )


def detected_cells(counts: DataFrame, cells: DataFrame, genes: DataFrame, minimum: int) -> DataFrame:
    """Cells in which each gene is detected, and whether the gene may enter a model."""
    found = (
        counts.filter(F.col("umi") > 0)
        .join(cells.select("cell_id"), "cell_id", "left_semi")
        .groupBy("gene_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0))
    return genes.join(found, "gene_id", "left").select(
        "gene_id", n.alias("detected_cells"), ((n >= minimum) & ~F.col("is_mt")).alias("model_eligible")
    )


def variable_genes(
    normalised: DataFrame, cells: DataFrame, genes: DataFrame, n_top: int, n_bins: int = 20, batch: str = "library"
) -> DataFrame:
    """Highly variable genes chosen within batches and combined over batches.

    Per batch, mean and sample variance of ``expm1`` values over all cells of the batch
    (zeros included) give a log dispersion, standardised within equal-width bins of the
    log mean. Genes are then ordered by the number of batches ranking them in their top
    ``n_top`` and by mean normalised dispersion. ``genes`` limits the candidates. Values that
    carry their batch meet no cells again.
    """
    size = cells.groupBy(batch).agg(F.count(F.lit(1)).cast("double").alias("_cells"))
    x = F.expm1("value")
    placed = normalised if batch in normalised.columns else normalised.join(cells.select("cell_id", batch), "cell_id")
    sums = (
        placed.groupBy(batch, "gene_id")
        .agg(F.sum(x).alias("_s1"), F.sum(x * x).alias("_s2"))
        .join(genes.select("gene_id"), "gene_id", "left_semi")
    )
    sums = join_statistics(sums, size, [batch])
    mean = F.col("_s1") / F.col("_cells")
    var = F.try_divide(F.col("_s2") - F.col("_cells") * mean * mean, F.col("_cells") - F.lit(1.0))
    stats = sums.select(
        batch,
        "gene_id",
        F.log1p(mean).alias("log_mean"),
        F.when(var > 0, F.log(var / mean)).alias("log_dispersion"),
    ).filter(F.col("log_dispersion").isNotNull())
    stats = cut_lineage(stats)  # one row per batch and gene, read three times below
    span = stats.groupBy(batch).agg(F.min("log_mean").alias("_lo"), F.max("log_mean").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    spot = F.floor(F.try_divide(F.col("log_mean") - F.col("_lo"), width))
    binned = join_statistics(stats, span, [batch]).select(
        batch,
        "gene_id",
        "log_mean",
        "log_dispersion",
        F.least(F.lit(n_bins - 1), F.coalesce(spot, F.lit(0))).cast("int").alias("bin"),
    )
    moments = binned.groupBy(batch, "bin").agg(
        F.avg("log_dispersion").alias("_mu"),
        F.stddev_samp("log_dispersion").alias("_sd"),
        F.count(F.lit(1)).alias("_n"),
    )
    single = (F.col("_n") == 1) | (F.col("_sd") == 0)
    scored = join_statistics(binned, moments, [batch, "bin"]).withColumn(
        "norm_dispersion",
        F.when(single, F.lit(1.0)).otherwise(
            F.try_divide(F.col("log_dispersion") - F.col("_mu"), F.col("_sd"))
        ),
    )
    # row_number <= n lets Spark keep only n rows per batch and task before the shuffle
    order = Window.partitionBy(batch).orderBy(F.col("_key").desc(), F.col("gene_id"))
    keyed = scored.withColumn("_key", F.round("norm_dispersion", 9))
    top = keyed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n_top)
    hits = top.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_batches"))
    return (
        keyed.groupBy("gene_id")
        .agg(F.avg("norm_dispersion").alias("mean_norm_dispersion"))
        .join(hits, "gene_id", "left")
        .withColumn("n_batches", F.coalesce("n_batches", F.lit(0)))
        .orderBy(F.col("n_batches").desc(), F.round("mean_norm_dispersion", 9).desc(), "gene_id")
        .limit(n_top)
    )


def gene_sums(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Group by gene sums for both QC tiers, side by side, in one pass over the counts.

    ``cells`` are the primary-kept cells with donor, cell_type, total and qc_strict. This is
    the one join of the counts with the cells; everything later reads its small result.
    """
    info = cells.filter("qc_primary").select("cell_id", "donor", "cell_type", "total", "qc_strict")
    x = depth_normalised(F.col("umi"), F.col("total"))
    strict = lambda v: F.when(F.col("qc_strict"), v)
    return (
        counts.filter(F.col("umi") > 0)
        .join(info, "cell_id")
        .groupBy("donor", "cell_type", "gene_id")
        .agg(
            F.sum("umi").alias("_g_primary"),
            F.count(F.lit(1)).alias("_d_primary"),
            F.sum(x).alias("_x_primary"),
            F.sum(strict(F.col("umi"))).alias("_g_strict"),
            F.count(strict(F.col("umi"))).alias("_d_strict"),
            F.sum(strict(x)).alias("_x_strict"),
        )
    )


def tier_rows(sums: DataFrame) -> DataFrame:
    """Gene sums in long form, one row per tier in which the gene was detected."""
    keys = [c for c in sums.columns if not c.startswith("_")]
    return _tiers(sums, keys, SUM_COLUMNS).filter(F.col("n_detected") > 0)


def _tiers(wide: DataFrame, keys: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("qc"), *[F.col(f"{p}_{t}").alias(n) for p, n in names.items()])
            for t in TIERS
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_t")).select(*keys, "_t.*")


def group_totals(cells: DataFrame) -> DataFrame:
    """Cells and total counts of each QC tier, donor and type that has any."""
    strict = lambda v: F.when(F.col("qc_strict"), v)
    wide = (
        cells.filter("qc_primary")
        .groupBy("donor", "cell_type")
        .agg(
            F.count(F.lit(1)).alias("_n_primary"),
            F.sum("total").alias("_a_primary"),
            F.count_if("qc_strict").alias("_n_strict"),
            F.sum(strict(F.col("total"))).alias("_a_strict"),
        )
    )
    return _tiers(wide, ["donor", "cell_type"], {"_n": "n_cells", "_a": "sum_all"}).filter(F.col("n_cells") > 0)


def scaffold(keys: DataFrame, **declared: Sequence[str]) -> DataFrame:
    """Every combination of the keys with short declared lists (expanded from literals)."""
    out = keys
    for name, values in declared.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def pseudobulk(
    sums: DataFrame,
    totals: DataFrame,
    genes: DataFrame,
    donors: Sequence[str],
    types: Sequence[str],
    minimum: int,
) -> DataFrame:
    """Full cube over tier, donor, type and listed gene; empty groups are NULL, never zero.

    ``genes`` has ``gene_id`` and ``gene_in_matrix``: a gene without a column in the matrix
    keeps NULL values everywhere, a gene with one has true zeros where no count is stored.
    """
    frame = cube_frame(sums, genes, donors, types)
    rows = _tiers(frame, ["donor", "cell_type", "gene_id", "gene_in_matrix"], SUM_COLUMNS)
    return cube_values(rows, totals, donors, types, minimum)


def tiers_apart(frame: DataFrame) -> DataFrame:
    """A stored :func:`cube_frame` as rows of the tiers, each read by itself, so that who wants one reads only its columns."""
    keys = ["donor", "cell_type", "gene_id", "gene_in_matrix"]
    one = lambda t: frame.select(F.lit(t).alias("qc"), *keys, *[F.col(f"{p}_{t}").alias(n) for p, n in SUM_COLUMNS.items()])
    return reduce(DataFrame.unionByName, map(one, TIERS))


def cube_frame(sums: DataFrame, genes: DataFrame, donors: Sequence[str], types: Sequence[str]) -> DataFrame:
    """The sums of both tiers side by side for every listed gene, donor and type."""
    # genes meet their sums before they are repeated for the groups, and a gene's rows stay together: who groups them by gene
    # combines them in the task that reads them; tiers are unfolded after that
    number = lambda of, c: F.array_position(F.array(*[F.lit(x) for x in of]), F.col(c)) - 1
    n_types, values = len(types), [c for c in sums.columns if c.startswith("_")]
    own = (
        sums.filter(F.col("donor").isin(list(donors)) & F.col("cell_type").isin(list(types)))
        .withColumn("_at", (number(donors, "donor") * n_types + number(types, "cell_type")).cast("int"))
        .groupBy("gene_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("_at", F.struct(*values)))).alias("_own"))
    )
    groups = F.array(
        *[
            F.struct(F.lit(d).alias("donor"), F.lit(t).alias("cell_type"), F.try_element_at("_own", F.lit(i * n_types + j)).alias("_v"))
            for i, d in enumerate(donors)
            for j, t in enumerate(types)
        ]
    )
    frame = genes.select("gene_id", "gene_in_matrix").join(own, "gene_id", "left").select("gene_id", "gene_in_matrix", F.explode(groups).alias("_g"))
    return frame.select("gene_id", "gene_in_matrix", "_g.donor", "_g.cell_type", "_g._v.*")


def cube_values(rows: DataFrame, totals: DataFrame, donors: Sequence[str], types: Sequence[str], minimum: int) -> DataFrame:
    """The cube's values from the sums of one tier a row and the groups' totals."""
    keys = ["qc", "donor", "cell_type"]
    # at most tiers x donors x types rows, all of them declared lists
    groups = totals.filter(F.col("donor").isin(list(donors)) & F.col("cell_type").isin(list(types)))
    joined = rows.join(F.broadcast(groups), keys, "left")
    n = F.coalesce("n_cells", F.lit(0))
    seen = (n > 0) & F.col("gene_in_matrix")
    gene_sum = F.when(seen, F.coalesce("sum_gene", F.lit(0)))
    per_million = cpm(gene_sum, F.col("sum_all"))
    status = (
        F.when(~F.col("gene_in_matrix"), "gene_not_in_matrix")
        .when(n == 0, "no_cells")
        .when(n < minimum, "below_minimum")
        .otherwise("eligible")
    )
    return joined.select(
        *keys,
        "gene_id",
        n.alias("n_cells"),
        F.coalesce("sum_all", F.lit(0)).alias("sum_all_umis"),
        gene_sum.alias("sum_gene_umis"),
        per_million.alias("cpm"),
        F.log1p(per_million).alias("log1p_cpm"),
        F.when(seen, F.coalesce("sum_value", F.lit(0.0)) / n).alias("mean_log1p_cp10k"),
        F.when(seen, F.lit(100.0) * F.coalesce("n_detected", F.lit(0)) / n).alias("pct_detected"),
        "gene_in_matrix",
        (status == "eligible").alias("eligible"),
        status.alias("status"),
    )


def balanced_means(cube: DataFrame, keys: Sequence[str] = ("qc", "cell_type", "gene_id")) -> DataFrame:
    """Equal-donor means over eligible donors, with donor and cell counts."""
    ok = lambda c: F.when(F.col("eligible"), F.col(c))
    return cube.groupBy(*keys).agg(
        F.count_if("eligible").alias("eligible_donors"),
        F.sum("n_cells").alias("total_cells"),
        F.avg(ok("log1p_cpm")).alias("mean_log1p_cpm"),
        F.avg(ok("mean_log1p_cp10k")).alias("mean_log1p_cp10k"),
        F.avg(ok("pct_detected")).alias("mean_pct_detected"),
    )


def shared_types(totals: DataFrame, donors: Sequence[str], types: Sequence[str], minimum: int) -> DataFrame:
    """Types with at least ``minimum`` cells in every listed donor, per tier (relational division)."""
    wide = totals.groupBy("qc", "cell_type").agg(
        *[F.coalesce(F.max(F.when(F.col("donor") == d, F.col("n_cells"))), F.lit(0)).alias(f"_d{i}") for i, d in enumerate(donors)]
    )
    least = F.least(*[F.col(f"_d{i}") for i in range(len(donors))]) if len(donors) > 1 else F.col("_d0")
    return (
        wide.filter(F.col("cell_type").isin(list(types)))
        .filter(least >= minimum)
        .select("qc", "cell_type", least.alias("smallest_donor_cells"))
    )


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Zero-filled cross table with one column per declared value."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(f"n_{v}") for v in values])



def panel_statistics(
    normalised: DataFrame,
    cells: DataFrame,
    label: str,
    labels: Sequence[str],
    panel: DataFrame,
    matrix_genes: DataFrame,
) -> DataFrame:
    """Per declared label and panel gene: mean normalised value and detection over all cells of the label."""
    present = matrix_genes.select("gene_id").distinct().withColumn("_in", F.lit(True))
    wanted = panel.join(present, "gene_id", "left").withColumn("gene_in_matrix", F.col("_in").isNotNull()).drop("_in")
    size = cells.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells"))
    sums = (
        normalised.join(panel.select("gene_id").distinct(), "gene_id", "left_semi")
        .join(cells.select("cell_id", label), "cell_id")
        .groupBy(label, "gene_id")
        .agg(F.sum("value").alias("_x"), F.count(F.lit(1)).alias("_d"))
    )
    frame = scaffold(wanted, **{label: labels}).join(F.broadcast(size.filter(F.col(label).isin(*labels))), label)  # declared labels
    known = F.col("gene_in_matrix")
    return frame.join(sums, [label, "gene_id"], "left").select(
        label,
        *wanted.columns,
        "n_cells",
        F.when(known, F.coalesce("_x", F.lit(0.0)) / F.col("n_cells")).alias("mean_value"),
        F.when(known, F.lit(100.0) * F.coalesce("_d", F.lit(0)) / F.col("n_cells")).alias("pct_detected"),
    )


def column_z(df: DataFrame, column: str, value: str, name: str = "z") -> DataFrame:
    """Population z-score of ``value`` across the rows of each column; zero spread gives NULL."""
    stats = df.groupBy(column).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return join_statistics(df, stats, [column]).withColumn(
        name, F.try_divide(F.col(value) - F.col("_mu"), F.when(F.col("_sd") > 0, F.col("_sd")))
    ).drop("_mu", "_sd")


def cluster_annotation(
    members: DataFrame, panel_stats: DataFrame, cluster: str, label: str, labels: Sequence[str], donor: str
) -> DataFrame:
    """Audit of clusters: dominant known label, best panel by mean z, and largest donor share."""
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    by_label = members.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    dominant = by_label.groupBy(cluster).agg(
        F.sum("_n").alias("n_cells"),
        F.max_by(F.col(label), F.struct("_n", -order)).alias("dominant_label"),
        F.max("_n").alias("_top"),
    )
    donors = (
        members.groupBy(cluster, donor).agg(F.count(F.lit(1)).alias("_n")).groupBy(cluster).agg(F.max("_n").alias("_donor"))
    )
    z = column_z(panel_stats, "gene_id", "mean_value")
    panel_order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("panel"))
    scores = z.groupBy(cluster, "panel").agg(F.avg("z").alias("_z")).filter(F.col("_z").isNotNull())
    best = scores.groupBy(cluster).agg(
        F.max_by(F.col("panel"), F.struct(F.round("_z", 9), -panel_order)).alias("provisional_panel"),
        F.max("_z").alias("provisional_score"),
    )
    n = F.col("n_cells")
    return (
        dominant.join(donors, cluster)
        .join(best, cluster, "left")
        .select(
            cluster,
            "n_cells",
            "dominant_label",
            (F.col("_top") / n).alias("dominant_fraction"),
            F.coalesce("provisional_panel", F.lit("Unassigned")).alias("provisional_panel"),
            "provisional_score",
            (F.coalesce("provisional_panel", F.lit("Unassigned")) == F.col("dominant_label")).alias("panel_matches"),
            (F.col("_donor") / n).alias("largest_donor_fraction"),
        )
    )


def entity_details(cells: DataFrame, key: str, constants: Sequence[str], sample: str) -> DataFrame:
    """Size, attributes and distinct samples of each entity; a varying attribute is flagged."""
    return cells.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.min(c).alias(c) for c in constants],
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"{c}_constant") for c in constants],
        F.countDistinct(sample).alias("n_samples"),
    )


def sparsity(cube: DataFrame, threshold: int = 50) -> DataFrame:
    """Total counts and donors with any count per gene over the primary tier, with a sparse flag."""
    per = (
        cube.filter(F.col("qc") == "primary").groupBy("gene_id", "donor").agg(F.sum("sum_gene_umis").alias("_d"))
    )
    return per.groupBy("gene_id").agg(
        F.sum("_d").alias("assigned_umis"),
        F.count_if(F.col("_d") > 0).alias("donors_detected"),
        F.coalesce(F.sum("_d") < threshold, F.lit(False)).alias("sparse_flag"),
    )


def relative_to_maximum(balanced: DataFrame, required_donors: int) -> DataFrame:
    """Value over the gene's maximum; types lacking donors and all-zero genes give NULL."""
    value = F.when(F.col("eligible_donors") == required_donors, F.col("mean_log1p_cpm"))
    shown = balanced.withColumn("_v", value)
    peak = shown.groupBy("gene_id").agg(F.max("_v").alias("_max"))
    return shown.join(peak, "gene_id").select(
        "gene_id", "cell_type", share(F.col("_v"), F.col("_max")).alias("relative_to_max")
    )
