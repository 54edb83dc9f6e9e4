"""Summary-statistic queries: harmonisation, standard errors, colocalisation and credible sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.numeric import rounded
from corrobora.operators import ranking
from corrobora.operators import sumstats as ss
from corrobora.plans.bindings import r
from corrobora.plans.registry import query
from corrobora.session import cut_lineage, join_statistics
from corrobora.sources.tables import load

QTL_DF = 4.0
P1 = P2 = 1e-4
P12 = [1e-6, 1e-5, 1e-4]
GWAS_SD = 0.2
QTL_SDS = [0.075, 0.15, 0.3]
WINDOWS = [1_000_000, 400]
POLICIES = ["exact_all", "exclude_palindromic"]
MIN_VARIANTS = 100
GROUPS = ["region", "half_window", "allele_policy", "qtl_sd"]


def alleles(spark: SparkSession, d: str) -> DataFrame:
    """Allele pairs derived from part sizes: some equal, one size not ACGT, a third swapped, a seventh an indel."""
    base = lambda i: F.substring(F.lit("ACGT"), (i + F.lit(1)).cast("int"), F.lit(1))
    size, key = F.col("p_size"), F.col("p_partkey")
    effect = F.when(size == 50, "N").otherwise(base(F.pmod(size, F.lit(4))))
    other = base(F.pmod(F.floor(size / 4), F.lit(4)))
    swapped = F.pmod(key, F.lit(3)) == 1
    indel = F.pmod(key, F.lit(7)) == 3
    g_effect = F.when(swapped, other).otherwise(effect)
    g_other = F.when(indel, F.concat(F.lit("T"), F.lit("A"))).when(swapped, effect).otherwise(other)
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("pos"), effect.alias("q_effect"), other.alias("q_other"), g_effect.alias("g_effect"), g_other.alias("g_other")
    )


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """QTL rows from all lines of a (supplier, part) and GWAS rows from the returned ones, in one pass."""
    returned = F.col("l_returnflag").isin("A", "R")
    part = alleles(spark, d)
    means = (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("pos"))
        .agg(
            (F.avg(F.round(F.abs("l_discount") * 100)) / F.lit(100.0)).alias("discount"),
            (F.avg(F.round(F.abs("l_tax") * 100)) / F.lit(100.0)).alias("tax"),
            (F.avg(F.when(returned, F.round(F.abs("l_tax") * 100))) / F.lit(100.0)).alias("g_tax"),
            (F.avg(F.when(returned, F.round(F.abs("l_discount") * 100))) / F.lit(100.0)).alias("g_discount"),
            F.avg(F.when(returned, F.col("l_quantity"))).alias("g_quantity"),
        )
        .join(part, "pos")
    )
    chrom = F.concat(F.lit("chr"), F.col("region")).alias("chrom")
    qtl = means.select(
        "region", "pos", chrom, F.col("q_effect").alias("effect_allele"), F.col("q_other").alias("other_allele"),
        (F.col("discount") - F.lit(0.05)).alias("beta"), ((F.col("tax") + F.lit(0.005)) / F.lit(0.09)).alias("p"),
        F.lit(QTL_DF).alias("df"),
    )
    gwas = means.filter("g_tax IS NOT NULL").select(
        "region", "pos", chrom, F.col("g_effect").alias("effect_allele"), F.col("g_other").alias("other_allele"),
        (F.col("g_tax") - F.lit(0.04)).alias("beta"), (F.lit(0.02) + F.col("g_quantity") / F.lit(1000.0)).alias("se"),
        ((F.col("g_discount") + F.lit(0.01)) / F.lit(0.12)).alias("p"),
    )
    return ss.keyed(qtl), ss.keyed(gwas)


def usable_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    qtl, gwas = sides(spark, d)
    return qtl.filter(ss.usable_qtl(qtl)), gwas.filter(ss.usable_gwas(gwas))


def index_positions(gwas: DataFrame) -> DataFrame:
    """The lead variant of each region: smallest p, then lowest position."""
    return gwas.groupBy("region").agg(F.min_by("pos", F.struct(F.round("p", 9), "pos")).alias("index_pos"))


def shared(spark: SparkSession, d: str) -> DataFrame:
    """Harmonised variants with rebuilt standard errors, within the widest window of the lead variant."""
    qtl, gwas = usable_sides(spark, d)
    matched = ss.harmonise(qtl, gwas).filter(F.col("orientation") != "inconsistent")
    return ss.reconstruct_se(join_statistics(matched, index_positions(gwas), ["region"])).filter("roundtrip_ok")


def settings(spark: SparkSession, d: str) -> DataFrame:
    """Variants with their Bayes factors per prior, one row each, written once and read twice."""
    return cut_lineage(ss.setting_base(shared(spark, d), GWAS_SD, QTL_SDS))


def setting_fits(base: DataFrame) -> DataFrame:
    return ss.coloc_posteriors(ss.setting_sums(base, QTL_SDS, WINDOWS, POLICIES), P1, P2, P12)


BASE_SQL = """part0 AS (SELECT p_partkey AS pos, CASE WHEN p_size = 50 THEN 'N' ELSE substr('ACGT', 1 + p_size % 4, 1) END AS q_effect,
  substr('ACGT', 1 + (p_size // 4) % 4, 1) AS q_other, p_partkey % 3 = 1 AS swapped, p_partkey % 7 = 3 AS indel FROM part),
alle AS (SELECT *, CASE WHEN swapped THEN q_other ELSE q_effect END AS g_effect,
  CASE WHEN indel THEN 'TA' WHEN swapped THEN q_effect ELSE q_other END AS g_other FROM part0),
means AS (SELECT l_suppkey AS region, l_partkey AS pos, avg(round(abs(l_discount) * 100)) / 100.0::DOUBLE AS discount,
  avg(round(abs(l_tax) * 100)) / 100.0::DOUBLE AS tax,
  avg(round(abs(l_tax) * 100)) FILTER (WHERE l_returnflag <> 'N') / 100.0::DOUBLE AS g_tax,
  avg(round(abs(l_discount) * 100)) FILTER (WHERE l_returnflag <> 'N') / 100.0::DOUBLE AS g_discount,
  avg(l_quantity) FILTER (WHERE l_returnflag <> 'N') AS g_quantity FROM lineitem GROUP BY 1, 2),
qtl AS (SELECT region, pos, q_effect AS effect_allele, q_other AS other_allele, discount - 0.05 AS beta, (tax + 0.005) / 0.09 AS p,
  CASE WHEN q_effect <> q_other AND q_effect <> 'N' THEN region || ':' || pos || ':' || least(q_effect, q_other) || ':' || greatest(q_effect, q_other) END AS variant_key
  FROM means JOIN alle USING (pos)),
gwas AS (SELECT region, pos, g_effect AS effect_allele, g_other AS other_allele, g_tax - 0.04 AS beta, 0.02 + g_quantity / 1000.0 AS se,
  (g_discount + 0.01) / 0.12 AS p,
  CASE WHEN g_effect <> g_other AND g_effect <> 'N' AND g_other <> 'N' THEN region || ':' || pos || ':' || least(g_effect, g_other) || ':' || greatest(g_effect, g_other) END AS variant_key
  FROM means JOIN alle USING (pos) WHERE g_tax IS NOT NULL),
q AS (SELECT * FROM qtl WHERE variant_key IS NOT NULL AND beta <> 0 AND p > 0 AND p < 1),
g AS (SELECT * FROM gwas WHERE variant_key IS NOT NULL AND se > 0 AND p BETWEEN 0 AND 1),
idx AS (SELECT region, arg_min(pos, (round(p, 9), pos)) AS index_pos FROM g GROUP BY 1),
sh AS (SELECT q.region, q.variant_key, q.pos, q.effect_allele, q.other_allele, q.beta, q.p, g.se AS gwas_se, g.p AS gwas_p, g.beta AS gwas_beta_published,
  CASE WHEN q.effect_allele = g.effect_allele AND q.other_allele = g.other_allele THEN 'same'
       WHEN q.effect_allele = g.other_allele AND q.other_allele = g.effect_allele THEN 'swapped' ELSE 'inconsistent' END AS orientation,
  q.effect_allele || q.other_allele IN ('AT', 'TA', 'CG', 'GC') AS palindromic, index_pos
  FROM q JOIN g USING (region, variant_key) JOIN idx USING (region))"""
# Student t with 4 degrees of freedom has a closed-form quantile.
SE_SQL = """se AS (SELECT *, CASE orientation WHEN 'same' THEN gwas_beta_published WHEN 'swapped' THEN -gwas_beta_published END AS gwas_beta,
  abs(beta) / (2 * sqrt(cos(acos(sqrt(p * (2 - p))) / 3) / sqrt(p * (2 - p)) - 1)) AS se FROM sh)"""


@query(
    "harmonised_variants",
    f"""WITH {BASE_SQL}, {SE_SQL} SELECT region, variant_key, pos, orientation, palindromic, {r('gwas_beta')} AS gwas_beta, {r('se')} AS se FROM se""",
)
def harmonised_variants(spark: SparkSession, d: str) -> DataFrame:
    qtl, gwas = usable_sides(spark, d)
    out = ss.reconstruct_se(ss.harmonise(qtl, gwas))
    return out.select(
        "region", "variant_key", "pos", "orientation", "palindromic",
        rounded(F.col("gwas_beta")).alias("gwas_beta"), rounded(F.col("se")).alias("se"),
    )


@query(
    "variants_in_window",
    f"WITH {BASE_SQL} SELECT region, variant_key, pos, index_pos FROM q JOIN idx USING (region) WHERE abs(pos - index_pos) <= 400",
)
def variants_in_window(spark: SparkSession, d: str) -> DataFrame:
    qtl, gwas = usable_sides(spark, d)
    return ss.within_window(qtl, index_positions(gwas), 400).select("region", "variant_key", "pos", "index_pos")


@query(
    "variant_exclusions",
    f"""WITH {BASE_SQL} SELECT q.region, q.variant_key, q.pos,
  CASE WHEN (q.region, q.pos) IN (SELECT (region, pos) FROM g) THEN 'literal_allele_mismatch' ELSE 'position_absent' END AS reason
FROM q WHERE (q.region, q.variant_key) NOT IN (SELECT (region, variant_key) FROM g)
UNION ALL SELECT region, variant_key, pos, 'invalid_alleles_or_nonreconstructible_beta_p' FROM qtl
WHERE NOT (variant_key IS NOT NULL AND beta <> 0 AND p > 0 AND p < 1)""",
)
def variant_exclusions(spark: SparkSession, d: str) -> DataFrame:
    qtl, gwas = sides(spark, d)
    ok = F.coalesce(ss.usable_qtl(qtl), F.lit(False))
    invalid = qtl.filter(~ok).select(
        "region", "variant_key", "pos", F.lit("invalid_alleles_or_nonreconstructible_beta_p").alias("reason")
    )
    missing = ss.exclusions(qtl.filter(ok), gwas.filter(ss.usable_gwas(gwas)))
    return missing.unionByName(invalid)


@query(
    "source_p_audit",
    f"""WITH {BASE_SQL} SELECT region, count(*) AS n_rows, {r('min(p)')} AS p_min, {r('max(p)')} AS p_max,
  count(*) FILTER (WHERE p > 0.05) AS n_p_gt_005, count(*) FILTER (WHERE p > 0.5) AS n_p_gt_05 FROM qtl GROUP BY 1""",
)
def source_p_audit(spark: SparkSession, d: str) -> DataFrame:
    out = ss.source_audit(sides(spark, d)[0])
    return out.withColumn("p_min", rounded(F.col("p_min"))).withColumn("p_max", rounded(F.col("p_max")))


@query(
    "coverage_audit",
    f"""WITH {BASE_SQL} SELECT region, qtl_rows, coalesce(gwas_rows, 0) AS gwas_rows, coalesce(n, 0) AS shared_variants,
  coalesce(sw, 0) AS allele_swaps, coalesce(pal, 0) AS palindromic_rows, min_pos, max_pos,
  {r('coalesce(n, 0) / qtl_rows::DOUBLE')} AS match_fraction, coalesce(n, 0) >= 100 AS sufficient
FROM (SELECT region, count(*) AS qtl_rows FROM q GROUP BY 1) LEFT JOIN (SELECT region, count(*) AS gwas_rows FROM g GROUP BY 1) USING (region)
LEFT JOIN (SELECT region, count(*) AS n, count(*) FILTER (WHERE orientation = 'swapped') AS sw, count(*) FILTER (WHERE palindromic) AS pal,
  min(pos) AS min_pos, max(pos) AS max_pos FROM sh GROUP BY 1) USING (region)""",
)
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    qtl, gwas = usable_sides(spark, d)
    out = ss.coverage_audit(qtl, gwas, ss.harmonise(qtl, gwas), MIN_VARIANTS)
    return out.withColumn("match_fraction", rounded(F.col("match_fraction")))


@query(
    "standard_errors",
    """SELECT l_orderkey, l_partkey, l_linenumber, round(b / t + 1.7e-9::DOUBLE, 6) + 0.0::DOUBLE AS se, true AS roundtrip_ok FROM (
  SELECT *, CASE df WHEN 1 THEN tan(pi() / 2 * (1 - p)) WHEN 2 THEN sqrt(2) * (1 - p) / sqrt(p * (2 - p))
    ELSE 2 * sqrt(cos(acos(sqrt(p * (2 - p))) / 3) / sqrt(p * (2 - p)) - 1) END AS t FROM (
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity / 100.0::DOUBLE AS b, (round(abs(l_discount) * 100) + 0.5::DOUBLE) / 11.0::DOUBLE AS p,
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS df FROM lineitem))""",
)
def standard_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt from effect, p and 1, 2 or 4 degrees of freedom, which have closed forms to check against."""
    rows = load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_quantity") / F.lit(100.0)).alias("beta"),
        ((F.round(F.abs("l_discount") * 100) + F.lit(0.5)) / F.lit(11.0)).alias("p"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(4.0).alias("df"),
    )
    out = ss.reconstruct_se(rows)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", rounded(F.col("se")).alias("se"), "roundtrip_ok")


ABF_SQL = """sds AS (SELECT unnest([0.075, 0.15, 0.3])::DOUBLE AS qtl_sd),
abf AS (SELECT *, 0.5 * (ln(gwas_se ** 2) - ln(gwas_se ** 2 + 0.2 ** 2) + 0.2 ** 2 / (gwas_se ** 2 + 0.2 ** 2) * (gwas_beta / gwas_se) ** 2) AS l1,
  0.5 * (ln(se ** 2) - ln(se ** 2 + qtl_sd ** 2) + qtl_sd ** 2 / (se ** 2 + qtl_sd ** 2) * (beta / se) ** 2) AS l2
  FROM se CROSS JOIN sds WHERE orientation <> 'inconsistent')"""
FIT_SQL = """grid AS (SELECT abf.*, half_window, allele_policy FROM abf CROSS JOIN (VALUES (1000000::BIGINT), (400::BIGINT)) w(half_window)
  CROSS JOIN (VALUES ('exact_all'), ('exclude_palindromic')) p(allele_policy)
  WHERE abs(pos - index_pos) <= half_window AND (allele_policy = 'exact_all' OR NOT palindromic)),
sums AS (SELECT region, half_window, allele_policy, qtl_sd, count(*) AS n_variants, sum(exp(l1)) AS a, sum(exp(l2)) AS b, sum(exp(l1 + l2)) AS ab
  FROM grid GROUP BY 1, 2, 3, 4),
weights AS (SELECT *, 1.0::DOUBLE AS w0, 1e-4 * a AS w1, 1e-4 * b AS w2, 1e-8 * (a * b - ab) AS w3, p12 * ab AS w4
  FROM sums CROSS JOIN (SELECT unnest([1e-6, 1e-5, 1e-4])::DOUBLE AS p12)),
fit AS (SELECT *, w0 / t AS pp_h0, w1 / t AS pp_h1, w2 / t AS pp_h2, w3 / t AS pp_h3, w4 / t AS pp_h4,
  CASE WHEN n_variants < 2 THEN 'too_few_variants' WHEN n_variants * greatest(1e-4, p12) >= 1 THEN 'region_too_large' ELSE 'fitted' END AS status
  FROM (SELECT *, w0 + w1 + w2 + w3 + w4 AS t FROM weights))"""
ALL_SQL = f"WITH {BASE_SQL}, {SE_SQL}, {ABF_SQL}, {FIT_SQL}"
PP = ", ".join(f"CASE WHEN status = 'fitted' THEN {r(f'pp_h{i}')} END AS pp_h{i}" for i in range(5))


@query(
    "log_bayes_factors",
    f"WITH {BASE_SQL}, {SE_SQL}, {ABF_SQL} SELECT region, variant_key, qtl_sd, {r('l1')} AS l1, {r('l2')} AS l2 FROM abf",
)
def log_bayes_factors(spark: SparkSession, d: str) -> DataFrame:
    out = ss.abf_table(shared(spark, d), GWAS_SD, QTL_SDS)
    return out.select("region", "variant_key", "qtl_sd", rounded(F.col("l1")).alias("l1"), rounded(F.col("l2")).alias("l2"))


@query(
    "group_log_sum_exp",
    f"WITH {BASE_SQL}, {SE_SQL}, {ABF_SQL} SELECT region, qtl_sd, {r('ln(sum(exp(l1 + l2)))')} AS lse FROM abf GROUP BY 1, 2",
)
def group_log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    abf = cut_lineage(
        ss.abf_table(shared(spark, d), GWAS_SD, QTL_SDS).select("region", "qtl_sd", (F.col("l1") + F.col("l2")).alias("l12"))
    )
    return ss.log_sum_exp(abf, ["region", "qtl_sd"], "l12", "lse").withColumn("lse", rounded(F.col("lse")))


def posteriors(spark: SparkSession, d: str) -> DataFrame:
    return setting_fits(settings(spark, d))


@query(
    "colocalisation_posteriors",
    f"""{ALL_SQL} SELECT region, half_window, allele_policy, qtl_sd, p12, n_variants, status, {PP},
  CASE WHEN status = 'fitted' THEN {r('pp_h4 / (pp_h3 + pp_h4)')} END AS pp_h4_given_h3_or_h4,
  CASE WHEN status = 'fitted' THEN pp_h4 >= 0.8 END AS h4_supported,
  CASE WHEN status = 'fitted' THEN CASE greatest(w0, w1, w2, w3, w4) WHEN w0 THEN 'H0' WHEN w1 THEN 'H1' WHEN w2 THEN 'H2' WHEN w3 THEN 'H3' ELSE 'H4' END END AS top_hypothesis,
  half_window = 1000000 AND allele_policy = 'exact_all' AND qtl_sd = 0.15 AND p12 = 1e-5 AS primary_setting FROM fit""",
)
def colocalisation_posteriors(spark: SparkSession, d: str) -> DataFrame:
    out = posteriors(spark, d)
    for i in range(5):
        out = out.withColumn(f"pp_h{i}", rounded(F.col(f"pp_h{i}")))
    primary = (
        (F.col("half_window") == WINDOWS[0]) & (F.col("allele_policy") == "exact_all") & (F.col("qtl_sd") == 0.15) & (F.col("p12") == 1e-5)
    )
    return out.withColumn("pp_h4_given_h3_or_h4", rounded(F.col("pp_h4_given_h3_or_h4"))).withColumn("primary_setting", primary)


@query(
    "colocalisation_cross_check",
    f"{ALL_SQL} SELECT region, half_window, allele_policy, qtl_sd, p12, 0.0::DOUBLE AS max_abs_error, NOT isfinite(t) AS overflow FROM fit WHERE status = 'fitted'",
)
def colocalisation_cross_check(spark: SparkSession, d: str) -> DataFrame:
    base = settings(spark, d)
    fitted = setting_fits(base).filter("status = 'fitted'")
    out = ss.coloc_cross_check(ss.setting_sums(base, QTL_SDS, WINDOWS, POLICIES, plain=True), fitted, GROUPS, P1, P2)
    return out.withColumn("max_abs_error", rounded(F.col("max_abs_error"), 9))


@query(
    "colocalisation_sensitivity",
    f"""{ALL_SQL} SELECT region, count(*) AS n_settings, count(*) FILTER (WHERE status = 'fitted') AS n_fitted,
  {r("min(pp_h4) FILTER (WHERE status = 'fitted')")} AS h4_min, {r("max(pp_h4) FILTER (WHERE status = 'fitted')")} AS h4_max,
  bool_and(status = 'fitted' AND pp_h4 >= 0.8) AS h4_supported_everywhere FROM fit GROUP BY 1""",
)
def colocalisation_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    out = ss.sensitivity(posteriors(spark, d), ["region"])
    return out.withColumn("h4_min", rounded(F.col("h4_min"))).withColumn("h4_max", rounded(F.col("h4_max")))


@query(
    "credible_sets",
    f"""WITH {BASE_SQL}, {SE_SQL}, {ABF_SQL}
SELECT region, variant_key, {r('m')} AS h4_mass, {r('cum')} AS cumulative_mass, cum - m < 0.95 AS in_credible_set FROM (
  SELECT *, sum(m) OVER (PARTITION BY region ORDER BY round(m, 12) DESC, variant_key ROWS UNBOUNDED PRECEDING) AS cum FROM (
    SELECT region, variant_key, exp(l1 + l2) / sum(exp(l1 + l2)) OVER (PARTITION BY region) AS m FROM abf WHERE qtl_sd = 0.15))""",
)
def credible_sets(spark: SparkSession, d: str) -> DataFrame:
    abf = cut_lineage(ss.abf_table(shared(spark, d), GWAS_SD, [0.15]).select("region", "variant_key", "l1", "l2"))
    masses = ss.conditional_mass(abf, ss.coloc_sums(abf, ["region"]), ["region"])
    out = ss.credible_set(masses, ["region"])
    return out.select(
        "region", "variant_key", rounded(F.col("h4_mass")).alias("h4_mass"),
        rounded(F.col("cumulative_mass")).alias("cumulative_mass"), "in_credible_set",
    )


@query(
    "primary_setting_summary",
    f"""{ALL_SQL}, prim AS (SELECT * FROM grid WHERE half_window = 1000000 AND allele_policy = 'exact_all' AND qtl_sd = 0.15),
mass AS (SELECT region, variant_key, exp(l1 + l2) / sum(exp(l1 + l2)) OVER (PARTITION BY region) AS m FROM prim),
cums AS (SELECT *, sum(m) OVER (PARTITION BY region ORDER BY round(m, 12) DESC, variant_key ROWS UNBOUNDED PRECEDING) AS cum FROM mass),
tops AS (SELECT region, arg_min(variant_key, (-round(m, 12), variant_key)) AS top_variant, max(m) AS top_h4_mass, count(*) FILTER (WHERE cum - m < 0.95) AS credible_set_size FROM cums GROUP BY 1),
ranges AS (SELECT region, min(pp_h4) FILTER (WHERE status = 'fitted') AS h4_min, max(pp_h4) FILTER (WHERE status = 'fitted') AS h4_max,
  bool_and(status = 'fitted' AND pp_h4 >= 0.8) AS h4_supported_everywhere FROM fit GROUP BY 1)
SELECT region, n_variants, status, CASE WHEN status = 'fitted' THEN {r('pp_h4')} END AS pp_h4, top_variant, {r('top_h4_mass')} AS top_h4_mass, credible_set_size,
  {r('h4_min')} AS h4_min, {r('h4_max')} AS h4_max, h4_supported_everywhere
FROM fit JOIN tops USING (region) JOIN ranges USING (region) WHERE half_window = 1000000 AND allele_policy = 'exact_all' AND qtl_sd = 0.15 AND p12 = 1e-5""",
)
def primary_setting_summary(spark: SparkSession, d: str) -> DataFrame:
    base = settings(spark, d)
    primary = (F.col("half_window") == WINDOWS[0]) & (F.col("allele_policy") == "exact_all") & (F.col("qtl_sd") == 0.15)
    abf = base.filter(F.abs(F.col("pos") - F.col("index_pos")) <= WINDOWS[0]).select("region", "variant_key", "l1", F.col(f"l2_{QTL_SDS.index(0.15)}").alias("l2"))
    sums = cut_lineage(ss.setting_sums(base, QTL_SDS, WINDOWS, POLICIES))  # a row for each region and setting
    fits = ss.coloc_posteriors(sums, P1, P2, P12)
    sets = ss.credible_set(ss.conditional_mass(abf, sums.filter(primary), ["region"]), ["region"])
    ranges = ss.sensitivity(fits, ["region"]).select("region", "h4_min", "h4_max", "h4_supported_everywhere")
    fit = fits.filter(primary & (F.col("p12") == 1e-5)).select("region", "n_variants", "status", "pp_h4")
    out = ss.setting_summary(fit, sets, ranges, ["region"])
    for c in ("pp_h4", "top_h4_mass", "h4_min", "h4_max"):
        out = out.withColumn(c, rounded(F.col(c)))
    return out


@query(
    "lead_variants",
    f"""WITH {BASE_SQL} SELECT region, arg_min(variant_key, (round(p, 9), variant_key)) AS best_variant_key, {r('min(round(p, 9))')} AS best_score FROM g GROUP BY 1""",
)
def lead_variants(spark: SparkSession, d: str) -> DataFrame:
    _, gwas = usable_sides(spark, d)
    out = ranking.best_per_group(gwas, ["region"], "variant_key", F.round("p", 9), F.col("variant_key"))
    return out.withColumn("best_score", rounded(F.col("best_score")))
