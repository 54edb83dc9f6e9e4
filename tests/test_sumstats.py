"""Standard errors, Bayes factors, posteriors and allele harmonisation."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.functions import tails
from corrobora.functions.numeric import log_abf
from corrobora.operators import sumstats as ss


def test_standard_error_recovery(spark):
    beta, se = np.array([0.2, -0.4, 0.001, 0.6]), np.array([0.06, 0.1, 0.08, 0.06])
    p = tails.t_two_sided(np.abs(beta / se), np.full(4, 404.0))
    rows = [(float(b), float(x), 404.0) for b, x in zip(beta, p)] + [(0.1, 0.0, 404.0), (0.1, 1.0, 404.0), (0.1, float("nan"), 404.0), (0.0, 0.5, 404.0)]
    out = ss.reconstruct_se(spark.createDataFrame(rows, "beta double, p double, df double").coalesce(1)).collect()
    np.testing.assert_allclose([r["se"] for r in out[:4]], se, rtol=2e-8)
    assert all(r["roundtrip_ok"] for r in out[:4])
    assert all(r["se"] is None and not r["roundtrip_ok"] for r in out[4:])


def test_t_tail_against_closed_forms():
    p = np.array([0.9, 0.5, 0.05, 1e-6, 1e-12])
    np.testing.assert_allclose(tails.t_magnitude(p, np.full(5, 1.0)), 1 / np.tan(np.pi / 2 * p), rtol=1e-10)
    np.testing.assert_allclose(tails.t_magnitude(p, np.full(5, 2.0)), np.sqrt(2) * (1 - p) / np.sqrt(p * (2 - p)), rtol=1e-10)


def posterior(spark, rows, **kw):
    df = spark.createDataFrame([("g", f"v{i}", float(a), float(b)) for i, (a, b) in enumerate(rows)], "region string, variant_key string, l1 double, l2 double")
    return ss.coloc_posteriors(ss.coloc_sums(df, ["region"]), 1e-4, 1e-4, [kw.get("p12", 1e-5)]).first()


def enumerate_pairs(rows, p12=1e-5):
    a, b = np.exp([r[0] for r in rows]), np.exp([r[1] for r in rows])
    h3 = sum(a[i] * b[j] for i in range(len(a)) for j in range(len(a)) if i != j)
    w = np.array([1, 1e-4 * a.sum(), 1e-4 * b.sum(), 1e-8 * h3, p12 * (a * b).sum()])
    return w / w.sum()


@pytest.mark.parametrize("seed", range(4))
def test_posteriors_equal_explicit_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(math.log(2), math.log(5)), (math.log(4), math.log(1)), (math.log(1), math.log(3))] if seed == 0 else rng.normal(0, 6, (12, 2)).tolist()
    got = posterior(spark, rows)
    np.testing.assert_allclose([got[f"pp_h{i}"] for i in range(5)], enumerate_pairs(rows), rtol=1e-12)
    back = posterior(spark, rows[::-1])
    np.testing.assert_allclose([back[f"pp_h{i}"] for i in range(5)], [got[f"pp_h{i}"] for i in range(5)], rtol=1e-12)


def test_extreme_bayes_factors_stay_finite(spark):
    same = posterior(spark, [(1000, 1000), (0, 0), (0, 0)])
    apart = posterior(spark, [(1000, 0), (0, 1000), (0, 0)])
    assert same["pp_h4"] > 0.99 and apart["pp_h3"] > 0.99
    for row in (same, apart):
        values = [row[f"pp_h{i}"] for i in range(5)]
        assert all(math.isfinite(v) for v in values) and sum(values) == pytest.approx(1)


def test_preconditions_become_statuses(spark):
    assert posterior(spark, [(1, 1)])["status"] == "too_few_variants"
    assert posterior(spark, [(1, 1), (2, 2)], p12=1e-3)["status"] == "invalid_prior"
    assert posterior(spark, [(1, 1), (float("nan"), 2)])["status"] == "invalid_bayes_factor"
    assert posterior(spark, [(1, 1), (3, float("inf"))])["pp_h4"] is None
    big = spark.range(10001).select(F.lit("g").alias("region"), F.col("id").cast("string").alias("variant_key"), F.lit(0.0).alias("l1"), F.lit(0.0).alias("l2"))
    row = ss.coloc_posteriors(ss.coloc_sums(big, ["region"]), 1e-4, 1e-4, [1e-5]).first()
    assert row["status"] == "region_too_large" and row["pp_h4"] is None


def test_log_bayes_factor_ignores_sign(spark):
    df = spark.createDataFrame([(0.2, 0.05), (-0.2, 0.05), (0.1, 0.0)], "b double, s double")
    out = [r["l"] for r in df.select(log_abf(F.col("b"), F.col("s"), F.lit(0.2)).alias("l")).collect()]
    v, w = 0.05**2, 0.2**2
    assert out[0] == out[1] == pytest.approx(0.5 * (math.log(v) - math.log(v + w) + w / (v + w) * 16))
    assert out[2] is None


def harmonised(spark):
    q = [(1, "A", "G"), (2, "A", "G"), (3, "A", "T"), (4, "TA", "T"), (5, "A", "C"), (6, "A", "C"), (7, "N", "C")]
    g = [(1, "A", "G"), (2, "G", "A"), (3, "A", "T"), (4, "TA", "T"), (5, "A", "G"), (8, "A", "C"), (7, "A", "C")]
    qtl = spark.createDataFrame([("r", "chr1", p, a, b, 0.1, 0.5, 10.0) for p, a, b in q], "region string, chrom string, pos long, effect_allele string, other_allele string, beta double, p double, df double")
    gwas = spark.createDataFrame([("r", "1", p, a, b, 0.3, 0.1, 0.5) for p, a, b in g], "region string, chrom string, pos long, effect_allele string, other_allele string, beta double, se double, p double")
    return ss.keyed(qtl), ss.keyed(gwas)


def test_harmonisation(spark):
    qtl, gwas = harmonised(spark)
    usable = qtl.filter(ss.usable_qtl(qtl))
    assert qtl.filter(~F.coalesce(ss.usable_qtl(qtl), F.lit(False))).count() == 1
    rows = {r["pos"]: r for r in ss.harmonise(usable, gwas).collect()}
    assert {p: r["orientation"] for p, r in rows.items()} == {1: "same", 2: "swapped", 3: "same", 4: "same"}
    assert rows[2]["gwas_beta"] == pytest.approx(-0.3) and rows[1]["gwas_beta"] == pytest.approx(0.3)
    assert [p for p, r in rows.items() if r["palindromic"]] == [3]
    reasons = {r["pos"]: r["reason"] for r in ss.exclusions(usable, gwas).collect()}
    assert reasons == {5: "literal_allele_mismatch", 6: "position_absent"}


def test_credible_set_boundary(spark):
    df = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.45), ("g", "c", 0.04), ("g", "d", 0.01)], "region string, variant_key string, h4_mass double")
    out = {r["variant_key"]: r["in_credible_set"] for r in ss.credible_set(df, ["region"], level=0.95).collect()}
    assert out["a"] and out["b"] and not out["d"]


def test_settings_are_columns_and_not_rows(spark):
    """All settings of a region at once against each of them alone; a variant goes through a shuffle once, not once a setting."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i % 3}", f"v{i}", i, 20, bool(i % 4 == 0), *map(float, rng.normal(0, 0.2, 2)), *map(float, rng.uniform(0.1, 0.3, 2))) for i in range(60)]
    rows += [("tied", f"t{i}", 20, 20, False, 0.1 * i, 0.2, 0.1, 0.1) for i in range(3)]
    shared = spark.createDataFrame(rows, "region string, variant_key string, pos long, index_pos long, palindromic boolean, gwas_beta double, beta double, gwas_se double, se double")
    base = ss.setting_base(shared, 0.2, [0.1, 0.3])
    assert base.count() == shared.count()
    got = {tuple(r)[:4]: r for r in ss.setting_sums(base, [0.1, 0.3], [100, 9], ["exact_all", "exclude_palindromic"]).collect()}
    plain = {tuple(r)[:4]: r for r in ss.setting_sums(base, [0.1, 0.3], [100, 9], ["exact_all", "exclude_palindromic"], plain=True).collect()}
    assert got.keys() == plain.keys() and len(got) == 3 * 8 + 1 * 8
    for (region, width, policy, sd), r in got.items():
        kept = [x for x in rows if x[0] == region and abs(x[2] - x[3]) <= width and not (policy != "exact_all" and x[4])]
        bayes = lambda beta, se, w: 0.5 * (math.log(se**2) - math.log(se**2 + w**2) + w**2 / (se**2 + w**2) * (beta / se) ** 2)
        a, b = (np.exp([bayes(x[i], x[i + 2], w) for x in kept]) for i, w in ((5, 0.2), (6, sd)))
        assert r.n_variants == len(kept) and r.finite_input
        apart = sum(a[i] * b[j] for i in range(len(a)) for j in range(len(a)) if i != j)
        np.testing.assert_allclose([r.lse1, r.lse2, r.lse_same, r.lse_different], np.log([a.sum(), b.sum(), (a * b).sum(), apart]), rtol=1e-10)
        np.testing.assert_allclose([plain[region, width, policy, sd][c] for c in ("_a", "_b", "_ab")], [a.sum(), b.sum(), (a * b).sum()], rtol=1e-10)
