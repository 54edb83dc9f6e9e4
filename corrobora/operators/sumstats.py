"""Summary-statistic harmonisation and colocalisation posteriors over a parameter grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.alleles import aligned, orientation, palindromic, variant_key
from corrobora.functions.numeric import NEG_INF, finite, log_abf, safe_log, share
from corrobora.functions.tails import standard_error, two_sided_p
from corrobora.operators.ordering import running_total
from corrobora.session import join_statistics

HYPOTHESES = ("H0", "H1", "H2", "H3", "H4")


def keyed(variants: DataFrame) -> DataFrame:
    """Add the order-free variant key (NULL for unusable alleles)."""
    return variants.withColumn(
        "variant_key", variant_key(F.col("chrom"), F.col("pos"), F.col("effect_allele"), F.col("other_allele"))
    )


def reconstruct_se(variants: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Standard error from effect, p-value and degrees of freedom, with a p-value round trip."""
    out = variants.withColumn("se", standard_error(F.col("beta"), F.col("p"), F.col("df")))
    again = two_sided_p(F.abs(F.col("beta") / F.col("se")), F.col("df"))
    return out.withColumn("p_roundtrip_error", F.abs(again - F.col("p")) / F.col("p")).withColumn(
        "roundtrip_ok", F.coalesce(F.col("p_roundtrip_error") <= tolerance, F.lit(False))
    )


def usable_qtl(variants: DataFrame) -> Column:
    """Rows from which a standard error can be rebuilt."""
    return (
        F.col("variant_key").isNotNull()
        & finite(F.col("beta"))
        & (F.col("beta") != 0)
        & F.coalesce((F.col("p") > 0) & (F.col("p") < 1), F.lit(False))
    )


def usable_gwas(variants: DataFrame) -> Column:
    """Rows with usable alleles, a finite effect, a positive error and a p-value in [0, 1]."""
    return (
        F.col("variant_key").isNotNull()
        & finite(F.col("beta"))
        & finite(F.col("se"))
        & F.coalesce(F.col("se") > 0, F.lit(False))
        & F.coalesce(F.col("p").between(0, 1), F.lit(False))
    )


def within_window(df: DataFrame, index: DataFrame, half_window: int) -> DataFrame:
    """Rows whose position is at most ``half_window`` from the region's index position."""
    return (
        join_statistics(df, index.select("region", "index_pos"), ["region"])
        .filter(F.col("pos").between(F.col("index_pos") - half_window, F.col("index_pos") + half_window))
    )


def harmonise(qtl: DataFrame, gwas: DataFrame) -> DataFrame:
    """Match on region and variant key and orient the second effect to the first.

    A pair whose alleles are neither equal nor swapped, or whose positions differ, stays in
    the result as ``inconsistent`` with a NULL aligned effect.
    """
    g = gwas.select(
        "region",
        "variant_key",
        F.col("pos").alias("g_pos"),
        F.col("effect_allele").alias("g_effect"),
        F.col("other_allele").alias("g_other"),
        F.col("beta").alias("gwas_beta_published"),
        F.col("se").alias("gwas_se"),
        F.col("p").alias("gwas_p"),
    )
    direction = F.when(
        F.col("pos") == F.col("g_pos"),
        orientation(F.col("effect_allele"), F.col("other_allele"), F.col("g_effect"), F.col("g_other")),
    ).otherwise("inconsistent")
    return (
        qtl.join(g, ["region", "variant_key"])
        .withColumn("orientation", direction)
        .withColumn("palindromic", palindromic(F.col("effect_allele"), F.col("other_allele")))
        .withColumn("gwas_beta", aligned(F.col("gwas_beta_published"), F.col("orientation")))
        .drop("g_pos", "g_effect", "g_other")
    )


def exclusions(qtl: DataFrame, gwas: DataFrame) -> DataFrame:
    """QTL rows without a partner, with the reason: same position but other alleles, or no position."""
    absent = qtl.join(gwas.select("region", "variant_key"), ["region", "variant_key"], "left_anti")
    places = gwas.select("region", "pos").distinct().withColumn("_at", F.lit(True))
    reason = F.when(F.col("_at"), "literal_allele_mismatch").otherwise("position_absent")
    return absent.join(places, ["region", "pos"], "left").select("region", "variant_key", "pos", reason.alias("reason"))


def source_audit(variants: DataFrame) -> DataFrame:
    """Row counts, p-value range and counts above two cut-offs for each region."""
    return variants.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
        F.count_if(F.col("p") > 0.05).alias("n_p_gt_005"),
        F.count_if(F.col("p") > 0.5).alias("n_p_gt_05"),
    )


def coverage_audit(qtl: DataFrame, gwas: DataFrame, shared: DataFrame, minimum: int) -> DataFrame:
    """Per region: rows on each side, matches, swaps, palindromes and whether coverage suffices."""
    q = qtl.groupBy("region").agg(F.count(F.lit(1)).alias("qtl_rows"))
    g = gwas.groupBy("region").agg(F.count(F.lit(1)).alias("gwas_rows"))
    m = shared.groupBy("region").agg(
        F.count(F.lit(1)).alias("shared_variants"),
        F.count_if(F.col("orientation") == "swapped").alias("allele_swaps"),
        F.count_if("palindromic").alias("palindromic_rows"),
        F.min("pos").alias("min_pos"),
        F.max("pos").alias("max_pos"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        q.join(g, "region", "left")
        .join(m, "region", "left")
        .select(
            "region",
            "qtl_rows",
            zero("gwas_rows"),
            zero("shared_variants"),
            zero("allele_swaps"),
            zero("palindromic_rows"),
            "min_pos",
            "max_pos",
            share(F.coalesce("shared_variants", F.lit(0)), F.col("qtl_rows")).alias("match_fraction"),
            (F.coalesce("shared_variants", F.lit(0)) >= minimum).alias("sufficient"),
        )
    )


def abf_table(shared: DataFrame, gwas_sd: float, qtl_sds: Sequence[float]) -> DataFrame:
    """Log Bayes factors of both traits, once per prior SD, before any wider grid is applied."""
    base = shared.withColumn("l1", log_abf(F.col("gwas_beta"), F.col("gwas_se"), F.lit(float(gwas_sd))))
    sds = F.explode(F.array(*[F.lit(float(s)) for s in qtl_sds]))
    return base.withColumn("qtl_sd", sds).withColumn("l2", log_abf(F.col("beta"), F.col("se"), F.col("qtl_sd")))


def setting_base(shared: DataFrame, gwas_sd: float, qtl_sds: Sequence[float]) -> DataFrame:
    """One row per variant with its log Bayes factors, the second trait's as one column ``l2_i`` for each prior SD."""
    return shared.select(
        "region", "variant_key", "pos", "index_pos", "palindromic",
        log_abf(F.col("gwas_beta"), F.col("gwas_se"), F.lit(float(gwas_sd))).alias("l1"),
        *[log_abf(F.col("beta"), F.col("se"), F.lit(float(s))).alias(f"l2_{i}") for i, s in enumerate(qtl_sds)],
    )


def _kept_by(half_window: int, policy: str) -> Column:
    inside = F.abs(F.col("pos") - F.col("index_pos")) <= half_window
    return inside if policy == "exact_all" else inside & ~F.col("palindromic")


def _unfolded(
    wide: DataFrame, names: Sequence[str], qtl_sds: Sequence[float], half_windows: Sequence[int], policies: Sequence[str]
) -> DataFrame:
    """A row for each setting of a region from columns ``<name>_<option>_<prior>``; settings without any variant have none."""
    rows = [
        F.struct(
            F.lit(w).cast("bigint").alias("half_window"), F.lit(policy).alias("allele_policy"), F.lit(float(s)).alias("qtl_sd"),
            *[F.col(f"{n}_{o}_{i}").alias(n) for n in names],
        )
        for o, (w, policy) in enumerate(product(half_windows, policies))
        for i, s in enumerate(qtl_sds)
    ]
    return wide.select("region", F.explode(F.array(*rows)).alias("_s")).select("region", "_s.*").filter("n_variants > 0")


def setting_sums(
    base: DataFrame, qtl_sds: Sequence[float], half_windows: Sequence[int], policies: Sequence[str], plain: bool = False
) -> DataFrame:
    """:func:`coloc_sums` of every setting of every region, from variants that are not repeated for the settings.

    ``base`` comes from :func:`setting_base`. All settings are columns of one row for each region, so that a shuffle moves a variant once.
    ``plain`` gives the sums of plain exponentials instead, for :func:`coloc_cross_check`.
    """
    options = [(o, _kept_by(w, policy)) for o, (w, policy) in enumerate(product(half_windows, policies))]
    priors = [(i, F.col(f"l2_{i}")) for i in range(len(qtl_sds))]
    grid = [(f"{o}_{i}", keep, l2) for (o, keep), (i, l2) in product(options, priors)]
    l1 = F.col("l1")
    if plain:
        cols = []
        for at, keep, l2 in grid:
            pick = lambda x, keep=keep: F.sum(F.when(keep, x))
            cols += [F.count_if(keep).alias(f"n_variants_{at}"), pick(F.exp(l1)).alias(f"_a_{at}"), pick(F.exp(l2)).alias(f"_b_{at}"), pick(F.exp(l1) * F.exp(l2)).alias(f"_ab_{at}")]
        return _unfolded(base.groupBy("region").agg(*cols), ["n_variants", "_a", "_b", "_ab"], qtl_sds, half_windows, policies)
    peaks = base.groupBy("region").agg(
        *[F.max(F.when(keep, x)).alias(f"{n}_{at}") for at, keep, l2 in grid for n, x in (("_m1", l1), ("_m2", l2), ("_m12", l1 + l2))]
    )
    met = join_statistics(base, peaks, ["region"])
    # the rows of a region stand together after the join, so a task has few sums to pass on
    fields = [
        F.when(
            keep,
            F.struct(
                F.lit(n).alias("at"), l2.alias("l2"), *[F.col(f"{m}_{at}").alias(m) for m in ("_m1", "_m2", "_m12")],
            ),
        )
        for n, (at, keep, l2) in enumerate(grid)
    ]
    rows = met.select("region", "l1", F.explode(F.array(*fields)).alias("_s")).filter("_s IS NOT NULL").select("region", "l1", "_s.*")
    sums = _scaled_sums(rows, ["region", "at"])
    places = [(w, policy, float(sd)) for (w, policy), sd in product(product(half_windows, policies), qtl_sds)]
    told = lambda k, kind: F.get(F.array(*[F.lit(v[k]).cast(kind) for v in places]), F.col("at"))
    named = [told(0, "bigint").alias("half_window"), told(1, "string").alias("allele_policy"), told(2, "double").alias("qtl_sd")]
    return sums.select("region", *named, *[c for c in sums.columns if c not in ("region", "at")])


def _scaled_sums(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sums of groups whose rows know their group's greatest ``l1``, ``l2`` and ``l1 + l2``.

    The sum over *different* variants, sum(i != j) a_i b_j, singles out the rows with the largest b, which is then one, be they one or
    several: what is subtracted is bounded by terms that are also added, so nothing is lost to cancellation.
    """
    a, b = F.exp(F.col("l1") - F.col("_m1")), F.exp(F.col("l2") - F.col("_m2"))
    ab = F.exp(F.col("l1") + F.col("l2") - F.col("_m12"))
    rest = ~F.coalesce(F.col("l2") == F.col("_m2"), F.lit(False))
    zero = F.lit(0.0)
    some = lambda x: F.coalesce(F.sum(x), zero)
    sums = rows.groupBy(*groups).agg(
        *[F.max(c).alias(c) for c in ("_m1", "_m2", "_m12")],
        F.count(F.lit(1)).alias("n_variants"),
        F.count_if(~finite(F.col("l1")) | ~finite(F.col("l2"))).alias("_invalid"),
        F.sum(a).alias("_a"),
        F.sum(b).alias("_b"),
        F.sum(ab).alias("_ab"),
        some(F.when(rest, a)).alias("_a_rest"),
        some(F.when(rest, b)).alias("_b_rest"),
        some(F.when(rest, a * b)).alias("_ab_rest"),
        some(F.when(~rest, a)).alias("_a_peak"),
        F.count_if(~rest).alias("_peaks"),
    )
    different = (
        F.col("_a_rest") * F.col("_peaks")
        + F.col("_a_peak") * (F.col("_b_rest") + F.col("_peaks") - 1)
        + F.greatest(F.col("_a_rest") * F.col("_b_rest") - F.col("_ab_rest"), zero)
    )
    return sums.select(
        *groups,
        "n_variants",
        (F.col("_invalid") == 0).alias("finite_input"),
        (F.col("_m1") + safe_log(F.col("_a"))).alias("lse1"),
        (F.col("_m2") + safe_log(F.col("_b"))).alias("lse2"),
        (F.col("_m1") + F.col("_m2") + safe_log(different)).alias("lse_different"),
        (F.col("_m12") + safe_log(F.col("_ab"))).alias("lse_same"),
    )


def coloc_sums(abf: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sufficient sums per group for the five hypothesis weights, in two aggregations.

    Every exponential is scaled by its group maximum.
    """
    groups = list(groups)
    peaks = abf.groupBy(*groups).agg(
        F.max("l1").alias("_m1"), F.max("l2").alias("_m2"), F.max(F.col("l1") + F.col("l2")).alias("_m12")
    )
    return _scaled_sums(join_statistics(abf, peaks, groups), groups)


def coloc_posteriors(sums: DataFrame, p1: float, p2: float, p12s: Sequence[float], decision: float = 0.8) -> DataFrame:
    """Posteriors of H0..H4 for each p12, with the conditional ratio, winner and decision.

    Groups that break a precondition (fewer than two variants, an invalid Bayes factor, or too
    many variants for the per-variant priors) keep their row with a status and NULL posteriors.
    """
    grid = F.explode(F.array(*[F.lit(float(x)) for x in p12s]))
    rows = sums.withColumn("p12", grid)
    valid_prior = (F.col("p12") > 0) & (F.col("p12") <= min(p1, p2)) & F.lit(max(p1, p2) < 1)
    status = (
        F.when(F.col("n_variants") < 2, "too_few_variants")
        .when(~F.col("finite_input"), "invalid_bayes_factor")
        .when(~valid_prior, "invalid_prior")
        .when(F.col("n_variants") * F.greatest(F.lit(max(p1, p2)), F.col("p12")) >= 1, "region_too_large")
        .otherwise("fitted")
    )
    weights = [
        F.lit(0.0),
        F.log(F.lit(p1)) + F.col("lse1"),
        F.log(F.lit(p2)) + F.col("lse2"),
        F.log(F.lit(p1)) + F.log(F.lit(p2)) + F.col("lse_different"),
        F.log("p12") + F.col("lse_same"),
    ]
    rows = rows.withColumn("status", status)
    for h, w in zip(HYPOTHESES, weights):
        rows = rows.withColumn(f"_w_{h}", F.when(F.col("status") == "fitted", F.coalesce(w, F.lit(NEG_INF))))
    top = F.greatest(*[F.col(f"_w_{h}") for h in HYPOTHESES])
    rows = rows.withColumn("_top", top)
    scaled = [F.exp(F.col(f"_w_{h}") - F.col("_top")) for h in HYPOTHESES]
    total = reduce(lambda x, y: x + y, scaled)
    rows = rows.select("*", *[(s / total).alias(f"pp_{h.lower()}") for h, s in zip(HYPOTHESES, scaled)])
    best = F.greatest(*[F.col(f"pp_{h.lower()}") for h in HYPOTHESES])
    winner = F.coalesce(*[F.when(F.col(f"pp_{h.lower()}") == best, F.lit(h)) for h in HYPOTHESES])
    keep = [c for c in rows.columns if not c.startswith("_") and not c.startswith("lse") and c != "finite_input"]
    return rows.select(
        *keep,
        F.try_divide(F.col("pp_h4"), F.col("pp_h3") + F.col("pp_h4")).alias("pp_h4_given_h3_or_h4"),
        winner.alias("top_hypothesis"),
        (F.col("pp_h4") >= decision).alias("h4_supported"),
    )


def coloc_cross_check(plain: DataFrame, posteriors: DataFrame, groups: Sequence[str], p1: float, p2: float) -> DataFrame:
    """Posteriors again by plain exponentials and sum(a) sum(b) - sum(ab); rows that overflow are flagged.

    ``plain`` has the sums of plain exponentials of each group, from :func:`setting_sums`.
    """
    groups = list(groups)
    j = posteriors.join(plain.select(*groups, "_a", "_b", "_ab"), groups)
    different = F.col("_a") * F.col("_b") - F.col("_ab")
    w = [F.lit(1.0), F.lit(p1) * F.col("_a"), F.lit(p2) * F.col("_b"), F.lit(p1 * p2) * different, F.col("p12") * F.col("_ab")]
    total = reduce(lambda x, y: x + y, w)
    ok = finite(total) & (different > 0)
    errors = [F.abs(x / total - F.col(f"pp_{h.lower()}")) for h, x in zip(HYPOTHESES, w)]
    return j.select(
        *groups,
        "p12",
        F.when(ok, F.greatest(*errors)).alias("max_abs_error"),
        (~ok).alias("overflow"),
    )


def sensitivity(posteriors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of H4 over all settings of a pair, and whether every setting supports it."""
    fitted = F.col("status") == "fitted"
    return posteriors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_settings"),
        F.count_if(fitted).alias("n_fitted"),
        F.min("pp_h4").alias("h4_min"),
        F.max("pp_h4").alias("h4_max"),
        F.bool_and(F.coalesce(F.col("h4_supported"), F.lit(False))).alias("h4_supported_everywhere"),
    )


def conditional_mass(abf: DataFrame, sums: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each variant's probability of being the shared one, given H4."""
    return join_statistics(abf, sums.select(*groups, "lse_same"), groups).withColumn(
        "h4_mass", F.exp(F.col("l1") + F.col("l2") - F.col("lse_same"))
    )


def credible_set(masses: DataFrame, groups: Sequence[str], level: float = 0.95, key: str = "variant_key") -> DataFrame:
    """Running mass in falling order; a variant is in the set while the mass before it is below the level."""
    total = running_total(
        masses.withColumn("_k", F.round("h4_mass", 12)), list(groups), [F.col("_k").desc(), F.col(key)], "h4_mass", "cumulative_mass"
    ).drop("_k")
    return total.withColumn("in_credible_set", F.col("cumulative_mass") - F.col("h4_mass") < level)


def setting_summary(fit: DataFrame, sets: DataFrame, ranges: DataFrame, groups: Sequence[str], key: str = "variant_key") -> DataFrame:
    """One row per pair of one setting: its fit, top variant, credible set size and the range over all settings.

    ``fit`` and ``ranges`` have one row per group; ``sets`` comes from :func:`credible_set`.
    """
    groups = list(groups)
    tops = sets.groupBy(*groups).agg(
        F.min_by(key, F.struct(-F.round("h4_mass", 12), key)).alias("top_variant"),
        F.max("h4_mass").alias("top_h4_mass"),
        F.count_if("in_credible_set").alias("credible_set_size"),
    )
    return fit.join(tops, groups, "left").join(ranges, groups, "left")


def log_sum_exp(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """``log(sum(exp(value)))`` per group without overflow."""
    peaks = df.groupBy(*groups).agg(F.max(value).alias("_m"))
    return (
        join_statistics(df, peaks, groups)
        .groupBy(*groups, "_m")
        .agg(F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s"))
        .select(*groups, (F.col("_m") + F.log("_s")).alias(name))
    )
