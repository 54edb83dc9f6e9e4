"""Sampling without replacement, thinning, matched references and their summaries.

Every draw is a hash of its labels, so a draw is the same for any partitioning, and a
lost executor recomputes exactly what it lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.draws import distinct_positions, draw_hash, hash_uniform
from corrobora.functions.numeric import cpm
from corrobora.functions.tails import thinned
from corrobora.operators.ordering import rank_in_group
from corrobora.operators.ranking import ALL_DONORS, comparisons, unique_winner
from corrobora.operators.stability import mixed, vector_total, word
from corrobora.session import cut_lineage, join_statistics

BUCKET_DIGITS = 3
UNIT_RUN = 1024
UNIT_DIGITS = 13
"""Hex digits of a hash that make a uniform number."""

RUN_CELLS = 1 << 26
"""Controls of a bin times draws made side by side."""

SHARE_UNIT = float(1 << 40)
"""Shares are summed in these parts of one."""

SHARES_AT_ONCE = 4096


def smallest_hashes(df: DataFrame, strata: Sequence[str], k: str, hexa: str, tie: str, few: bool = False) -> DataFrame:
    """The ``k`` rows with the smallest hash in every stratum, for strata of any size.

    A histogram over the leading hash digits finds the one bucket in which the k-th row
    lies, and ranking that bucket alone finds the k-th row itself. Every row is then compared with
    the k-th of its stratum, of which there is one, so the rows are not shuffled by stratum. Where the strata are
    ``few`` (bounded by parameters, not by rows) what is known of each goes to all tasks, and rows outside the k-th's bucket are not shuffled at all.
    """
    strata = list(strata)
    sent = F.broadcast if few else lambda x: x
    coded = df.withColumn("_b", F.substring(hexa, 1, BUCKET_DIGITS))
    hist = coded.groupBy(*strata, k, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        hist.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter((F.col("_before") < F.col(k)) & (F.col(k) <= F.col("_before") + F.col("_n")))
        .select(*strata, "_b", (F.col(k) - F.col("_before")).alias("_place"))
    )
    inside = Window.partitionBy(*strata, "_b").orderBy(hexa, tie)
    last = (
        coded.join(sent(edge), [*strata, "_b"])
        .withColumn("_r", F.row_number().over(inside))
        .filter(F.col("_r") == F.col("_place"))
        .select(*strata, F.struct(hexa, tie).alias("_last"))
    )
    reached = F.coalesce(F.struct(hexa, tie) <= F.col("_last"), F.col(k) > 0)
    met = df.join(sent(last), strata, "left") if few else join_statistics(df, last, strata, "left")
    return met.filter(reached).drop("_last")


def replicate(df: DataFrame, name: str, n: int) -> DataFrame:
    """Repeat rows for draw numbers 0..n-1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sampling_design(
    cells: DataFrame, strata: Sequence[str], fixed: dict[str, int], fractions: dict[str, float]
) -> DataFrame:
    """Cells to keep per scenario and stratum: a fixed number, or a rounded-down fraction, at least one."""
    size = cells.groupBy(*strata).agg(F.count(F.lit(1)).alias("available_cells"))
    rows = [
        F.struct(F.lit(s).alias("scenario"), F.lit(n).cast("bigint").alias("selected_cells"), F.lit(s).isNull().alias("_x"))
        for s, n in fixed.items()
    ] + [
        F.struct(
            F.lit(s).alias("scenario"),
            F.greatest(F.lit(1), F.floor(F.col("available_cells") * F.lit(float(f)))).cast("bigint").alias("selected_cells"),
            F.lit(s).isNull().alias("_x"),
        )
        for s, f in fractions.items()
    ]
    return (
        size.select(*strata, "available_cells", F.explode(F.array(*rows)).alias("_s"))
        .select(*strata, "available_cells", "_s.scenario", "_s.selected_cells")
        .withColumn("feasible", F.col("selected_cells") <= F.col("available_cells"))
    )


def scenario_status(design: DataFrame) -> DataFrame:
    """Per scenario its strata, those with too few cells, and whether it can be drawn at all."""
    return design.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.count_if(~F.col("feasible")).alias("n_short"),
        F.bool_and("feasible").alias("scenario_feasible"),
    )


def sample_cells(
    cells: DataFrame, design: DataFrame, strata: Sequence[str], reps: int, seed: int, few: bool = False
) -> DataFrame:
    """Cells drawn without replacement in every (scenario, rep, stratum).

    A scenario with too few cells in any stratum is not drawn, as a missing group is no zero. ``few`` says that the number of
    strata is bounded by parameters, see :func:`smallest_hashes`.
    """
    whole = scenario_status(design).filter("scenario_feasible").select("scenario")
    wanted = design.join(whole, "scenario", "left_semi").drop("available_cells", "feasible")
    met = cells.join(F.broadcast(wanted), list(strata)) if few else join_statistics(cells, wanted, strata)
    drawn = replicate(met, "rep", reps)
    labels = [F.lit(seed), F.col("scenario"), F.col("rep"), *[F.col(s) for s in strata], F.col("cell_id")]
    keyed = drawn.withColumn("_h", draw_hash(*labels))
    return smallest_hashes(keyed, ["scenario", "rep", *strata], "selected_cells", "_h", "cell_id", few).drop("_h")


def sampled_scores(sample: DataFrame, counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """log1p CPM per draw, donor, type and target gene; detected genes only, absent rows are zero."""
    totals = sample.groupBy(*keys).agg(F.sum("total").alias("_all"))
    wanted = counts.join(targets.select("gene_id"), "gene_id", "left_semi")
    sums = (
        sample.select("cell_id", *keys).join(wanted, "cell_id").groupBy(*keys, "gene_id").agg(F.sum("umi").alias("_g"))
    )
    return join_statistics(sums, totals, keys).select(
        *keys, "gene_id", F.log1p(cpm(F.col("_g"), F.col("_all"))).alias("score")
    )


def thin_counts(df: DataFrame, count: str, fraction: Column, labels: Sequence[Column], name: str) -> DataFrame:
    """Binomial draw of each count, keyed by its labels. The Arrow function sees plain columns only."""
    return df.withColumn(name, thinned(F.col(count).cast("bigint"), hash_uniform(draw_hash(*labels)), fraction))


def thin_units(df: DataFrame, count: str, fraction: Column, labels: Sequence[Column], name: str) -> DataFrame:
    """The same binomial draw by keeping each single unit on its own hash, in runs of ``UNIT_RUN``; rows are distinct."""
    n = F.col(count).cast("bigint")
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(n - 1, F.lit(0)) / UNIT_RUN))))
    first = F.col("_run") * UNIT_RUN + 1
    last = F.least(n, (F.col("_run") + 1) * UNIT_RUN)
    units = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    # hashes are compared as text with the bound's leading digits; the labels' text is made once a run
    bound = F.when(fraction >= 1, F.lit("g")).when(
        fraction < 1, F.lpad(F.lower(F.hex(F.greatest(F.lit(0).cast("bigint"), F.ceil(fraction * F.lit(float(16**UNIT_DIGITS)))))), UNIT_DIGITS, "0")
    )
    named = runs.withColumn("_label", F.concat_ws("|", *[x.cast("string") for x in labels])).withColumn("_bound", bound)
    hexa = F.md5(F.concat_ws("|", "_label", F.col("_unit").cast("string")))
    # rows of units stay in generated code, unlike a function of an array; a count of zero keeps its row
    each = named.withColumn("_unit", F.explode_outer(units))
    return each.groupBy(*df.columns).agg(F.count_if(F.col("_unit").isNotNull() & (hexa < F.col("_bound"))).alias(name))


def thinning_violations(df: DataFrame, groups: Sequence[str], count: str, total: str) -> DataFrame:
    """Groups whose selected counts exceed the declared library total."""
    return (
        df.groupBy(*groups)
        .agg(F.sum(count).alias("selected_total"), F.max(total).alias("library_total"))
        .filter(F.col("selected_total") > F.col("library_total"))
    )


def draw_winners(
    scores: DataFrame, keys: Sequence[str], types: Sequence[str], donors: Sequence[str]
) -> DataFrame:
    """Winner of the equal-donor mean for every draw; a type without the gene scores zero."""
    means = comparisons(scores, keys, types, {ALL_DONORS: donors}, F.col("score"), absent=0.0)
    return unique_winner(means, types).select(*keys, "top_type", "status")


def draw_tally(
    winners: DataFrame, baseline: DataFrame, types: Sequence[str], n_draws: int, keys: Sequence[str] = ("gene_id", "scenario")
) -> DataFrame:
    """Histogram of winners over draws with modal type, baseline agreement, zero and tie fractions.

    A draw in which the gene was not seen at all has no winner row and counts as a zero.
    """
    n = F.lit(float(n_draws))
    counts = [F.count_if(F.col("top_type") == t).alias(f"_n{i}") for i, t in enumerate(types)]
    wide = winners.groupBy(*keys).agg(
        *counts, F.count_if(F.col("status") == "tie").alias("_tie"), F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("status") == "no_UMIs").alias("_zero"),
    )
    cols = [F.col(f"_n{i}") for i in range(len(types))]
    best = F.greatest(*cols)
    modal = F.coalesce(*[F.when((c == best) & (c > 0), F.lit(t)) for c, t in zip(cols, types)])
    valid = sum(cols[1:], cols[0])
    agreement = F.coalesce(*[F.when(F.col("baseline_top_type") == t, c / n) for c, t in zip(cols, types)])
    return wide.join(baseline.select("gene_id", "baseline_top_type"), "gene_id", "left").select(
        *keys,
        F.lit(n_draws).cast("bigint").alias("n_draws"),
        valid.alias("valid_draws"),
        "baseline_top_type",
        agreement.alias("baseline_agreement"),
        modal.alias("modal_type"),
        F.when(valid > 0, best / n).otherwise(F.lit(0.0)).alias("modal_fraction"),
        ((F.col("_zero") + F.lit(n_draws) - F.col("_rows")) / n).alias("zero_fraction"),
        (F.col("_tie") / n).alias("tie_fraction"),
        *[(c / n).alias(f"top_fraction_{i}") for i, c in enumerate(cols)],
    )


def _drawn_positions(n_draws: int, at_once: int, seed: int):
    """Per bin and run of draws the positions drawn, each with a bitmap of the run's draws it is in.

    Floyd's sampling, one step for all draws of the run: a hash picks a position, or the step's last one if it is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, k, pool = row["run"] * at_once, row["k"], row["pool"]
                draws = range(first, min(n_draws, first + at_once))
                start = mixed(np.array([word(seed, "draw", d) for d in draws], np.uint64) ^ np.uint64(word(seed, "bin", row["bin"])))
                taken = np.zeros((pool, len(draws)), bool)
                column = np.arange(len(draws))
                for last in range(pool - k, pool):
                    pick = (mixed(start ^ np.uint64(last)) % np.uint64(last + 1)).astype(np.int64)
                    taken[np.where(taken[pick, column], last, pick), column] = True
                used = np.flatnonzero(taken.any(axis=1))
                bits = [b.tobytes() for b in np.packbits(taken[used], axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), row["bin"]), pa.int32()), pa.array(used), pa.array(np.full(len(used), row["run"]), pa.int32()), pa.array(bits, pa.binary())],
                    names=["bin", "_pos", "run", "bits"],
                )

    return run


def _null_sums(classes: Sequence[str], at_once: int):
    """Sums of shares over the rows of each run of draws, in integers so that their order does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            shares = np.stack([np.rint(batch.column(c).to_numpy() * SHARE_UNIT) for c in classes] + [np.ones(batch.num_rows)], axis=1)
            runs = batch.column("run").to_numpy()
            packed = batch.column("bits").to_pylist()
            for r in np.unique(runs).tolist():
                rows = np.flatnonzero(runs == r)
                for at in range(0, len(rows), SHARES_AT_ONCE):
                    some = rows[at : at + SHARES_AT_ONCE]
                    bits = np.unpackbits(np.frombuffer(b"".join([packed[i] for i in some]), np.uint8).reshape(len(some), -1), axis=1)
                    own = np.zeros((at_once, shares.shape[1]), np.int64)
                    width = min(at_once, bits.shape[1])
                    own[:width] = (bits[:, :width].T.astype(np.float64) @ shares[some]).astype(np.int64)
                    total[r] = total.get(r, 0) + own
        vectors = [v.tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(vectors, pa.binary())], names=["group", "vector"])

    return run


def reference_audit(genes: DataFrame) -> DataFrame:
    """Per bin its candidates and controls, and whether the controls suffice."""
    return genes.groupBy("bin").agg(
        F.count_if("is_candidate").alias("candidate_genes"),
        F.count_if(~F.col("is_candidate")).alias("control_genes"),
    ).withColumn("sufficient", F.col("control_genes") >= F.col("candidate_genes"))


def drawn_controls(genes: DataFrame, audit: DataFrame, classes: Sequence[str], n_draws: int, at_once: int, seed: int) -> DataFrame:
    """(run, bits, shares of the classes): every drawn control once for each run, with a bitmap of the run's draws it is in.

    The positions grow from a row for each bin, by whose size Spark would take them for a small table to be sent to all tasks.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(-(-n_draws // at_once) - 1))).alias("run")
    asked = audit.select(F.col("bin").cast("int"), F.least("candidate_genes", "control_genes").alias("k"), F.col("control_genes").alias("pool"), runs)
    tasks = int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.filter("k > 0").repartition(tasks, "bin", "run")
    positions = dealt.mapInArrow(_drawn_positions(n_draws, at_once, seed), "bin int, _pos long, run int, bits binary")
    controls = rank_in_group(genes.filter(~F.col("is_candidate")).select("bin", "gene_id", *classes), ["bin"], [F.col("gene_id")], "_pos")
    controls = controls.select(F.col("bin").cast("int"), (F.col("_pos") - 1).cast("long").alias("_pos"), *[F.col(c).cast("double") for c in classes])
    return positions.hint("merge").join(controls, ["bin", "_pos"]).select("run", "bits", *classes)


def matched_reference(
    genes: DataFrame, classes: Sequence[str], n_draws: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Random gene sets matched to the candidates by expression bin, and the empirical comparison.

    ``genes`` has gene_id, bin, is_candidate and one share column per class. In each draw and
    bin as many controls are drawn, without replacement, as the bin has candidates.
    Returns the per-class result and the per-bin audit. ``short_bins`` counts bins with fewer controls
    than candidates: draws are then not matched, and the result is not to be used.

    Controls are numbered in their bin once. A draw is positions, not rows: runs of draws are made side by side, and a drawn
    position meets its control once for each run, with a bitmap. Per draw and class one number comes to the driver.
    """
    spark = genes.sparkSession
    audit = cut_lineage(reference_audit(genes))  # a row for each bin
    largest = audit.agg(F.max("control_genes")).first()[0] or 1
    at_once = max(8, min(1000, RUN_CELLS // largest))
    met = drawn_controls(genes, audit, classes, n_draws, at_once, seed)
    sums = vector_total(met.mapInArrow(_null_sums(classes, at_once), "group int, vector binary"), at_once * (len(classes) + 1))
    rows = []
    for r, vector in sums.items():
        for i, (*own, n) in enumerate(vector.reshape(at_once, -1).tolist()):
            if n:
                rows.append((r * at_once + i, n, *(x / SHARE_UNIT / n for x in own)))
    null = spark.createDataFrame(rows, "draw long, _cases long, " + ", ".join(f"`{c}` double" for c in classes))
    observed = genes.filter("is_candidate").agg(
        F.count(F.lit(1)).alias("n_candidates"), *[F.avg(c).alias(c) for c in classes]
    )
    unpivot = lambda extra, value: F.explode(
        F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias(value)) for c in classes])
    ).alias("_x")
    null_long = null.select("draw", unpivot("draw", "null_mean")).select("draw", "_x.*")
    seen = observed.select("n_candidates", unpivot("n_candidates", "observed")).select("n_candidates", "_x.*")
    result = null_long.join(seen, "class").groupBy("class").agg(
        F.max("n_candidates").alias("n_candidates"),
        F.max("observed").alias("observed_mean_share"),
        F.avg("null_mean").alias("null_mean"),
        F.percentile("null_mean", F.lit(0.025)).alias("null_low"),
        F.percentile("null_mean", F.lit(0.975)).alias("null_high"),
        empirical_p(F.col("null_mean") >= F.col("observed")).alias("empirical_p"),
    )
    short = audit.agg(F.count_if(~F.col("sufficient")).alias("n")).scalar()
    return result.withColumn("short_bins", short), audit


def empirical_p(at_least: Column) -> Column:
    """Aggregate ``(1 + hits) / (1 + draws)``."""
    return (F.lit(1) + F.count_if(at_least)) / (F.lit(1) + F.count(F.lit(1)))


def control_audit(genes: DataFrame, panels: DataFrame, per_gene: int, minimum: int) -> DataFrame:
    """Per panel gene its bin, the controls there, and whether they suffice; a gene without a bin is ``not_expressed``."""
    pool = genes.join(panels.select("gene_id").distinct(), "gene_id", "left_anti")
    size = pool.groupBy("bin").agg(F.count(F.lit(1)).alias("pool_genes"))
    placed = panels.join(genes.select("gene_id", "bin"), "gene_id", "left")
    out = join_statistics(placed, size, ["bin"], "left").withColumn("pool_genes", F.coalesce("pool_genes", F.lit(0)))
    status = (
        F.when(F.col("bin").isNull(), "not_expressed")
        .when(F.least(F.lit(per_gene), "pool_genes") < minimum, "too_few_controls")
        .otherwise("drawn")
    )
    return out.select("program", "gene_id", "bin", "pool_genes", status.alias("status"))


def matched_controls(
    genes: DataFrame, panels: DataFrame, per_gene: int, minimum: int, seed: int
) -> DataFrame:
    """Up to ``per_gene`` distinct controls from the bin of every panel gene.

    ``genes`` has gene_id and bin; ``panels`` has program and gene_id. Genes of any panel are
    never controls. Controls are numbered within their bin once, and each panel gene draws
    numbers, so neither a bin nor its pairs are ever listed. Panel genes with fewer than ``minimum``
    controls are left out and named by :func:`control_audit`.
    """
    pool = genes.join(panels.select("gene_id").distinct(), "gene_id", "left_anti")
    numbered = rank_in_group(pool.select("gene_id", "bin"), ["bin"], [F.col("gene_id")], "_pos").select(
        "bin", (F.col("_pos") - F.lit(1)).alias("_pos"), F.col("gene_id").alias("control_gene")
    )
    size = pool.groupBy("bin").agg(F.count(F.lit(1)).alias("_pool"))
    asked = join_statistics(panels.join(genes.select("gene_id", "bin"), "gene_id"), size, ["bin"], "left")
    k = F.least(F.lit(per_gene), F.coalesce("_pool", F.lit(0)))
    drawn = asked.filter(k >= minimum).withColumn(
        "_pos",
        F.explode(distinct_positions(F.col("_pool"), k, F.lit(seed), F.col("program"), F.col("gene_id"))),
    )
    return drawn.join(numbered, ["bin", "_pos"]).select(
        "program", F.col("gene_id").alias("panel_gene"), "control_gene", "bin", k.alias("n_controls")
    )
