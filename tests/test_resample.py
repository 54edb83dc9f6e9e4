"""Sampling, thinning, matched references and programs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrobora.functions.draws import distinct_positions, draw_hash
from corrobora.functions.tails import binomial_quantile
from corrobora.operators import programs as pg
from corrobora.operators import ranking
from corrobora.operators import resample as rs


@pytest.mark.parametrize("partitions", [1, 7])
def test_smallest_hashes_is_exact_for_hot_strata(spark, partitions):
    n = 6000
    strata = ["hot" if i % 3 else f"s{i % 5}" for i in range(n)]
    df = spark.createDataFrame(list(zip(range(n), strata)), "id long, s string").repartition(partitions)
    keyed = df.withColumn("h", draw_hash(F.lit(1), F.col("id"))).withColumn("k", F.when(F.col("s") == "hot", 777).otherwise(3))
    got = {(r["s"], r["id"]) for r in rs.smallest_hashes(keyed, ["s"], "k", "h", "id").collect()}
    want = set()
    for s in set(strata):
        ids = sorted((hashlib.md5(f"1|{i}".encode()).hexdigest(), i) for i in range(n) if strata[i] == s)
        want |= {(s, i) for _, i in ids[: 777 if s == "hot" else 3]}
    assert got == want


def test_smallest_hashes_takes_all_of_a_small_stratum(spark):
    df = spark.range(5).select("id", F.lit("s").alias("s"), F.lit(9).alias("k"), F.lit("aaaa").alias("h"))
    assert rs.smallest_hashes(df, ["s"], "k", "h", "id").count() == 5


def test_distinct_positions_are_uniform_subsets(spark):
    rows = spark.range(6000).select(distinct_positions(F.lit(4), F.lit(2), F.lit(1), F.col("id")).alias("p")).collect()
    tally = Counter(frozenset(r["p"]) for r in rows)
    assert len(tally) == 6 and all(len(s) == 2 for s in tally)
    assert max(abs(v - 1000) for v in tally.values()) < 150
    full = spark.range(1).select(distinct_positions(F.lit(5), F.lit(5), F.lit(1)).alias("p")).first()["p"]
    assert sorted(full) == [0, 1, 2, 3, 4]
    assert spark.range(1).select(distinct_positions(F.lit(5), F.lit(0), F.lit(1)).alias("p")).first()["p"] == []


def test_binomial_quantile_matches_the_distribution():
    from math import comb

    n, p = 9, 0.3
    cdf = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    u = np.linspace(0, 0.9999, 500)
    want = np.searchsorted(cdf, u, side="right")
    assert (binomial_quantile(u, np.full(500, n), p) == want).all()
    assert (binomial_quantile(np.array([0.1, 0.9]), np.array([0, 4]), 1.0) == [0, 4]).all()


def test_scenario_with_a_short_stratum_is_not_drawn(spark):
    cells = spark.createDataFrame([(i, "A" if i < 30 else "B", 10) for i in range(35)], "cell_id long, donor string, total long")
    design = rs.sampling_design(cells, ["donor"], {"ten": 10, "three": 3}, {})
    told = {r["scenario"]: (r["n_short"], r["scenario_feasible"]) for r in rs.scenario_status(design).collect()}
    assert told == {"ten": (1, False), "three": (0, True)}
    drawn = rs.sample_cells(cells, design, ["donor"], 2, 1).groupBy("scenario", "rep", "donor").count().collect()
    assert {(r["scenario"], r["count"]) for r in drawn} == {("three", 3)} and len(drawn) == 4


def test_panel_genes_without_controls_are_named(spark):
    genes = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(50, 7)], "gene_id long, bin int")
    panels = spark.createDataFrame([("p", 0), ("p", 50), ("p", 99)], "program string, gene_id long")
    audit = {r["gene_id"]: r["status"] for r in rs.control_audit(genes, panels, 20, 5).collect()}
    assert audit == {0: "drawn", 50: "too_few_controls", 99: "not_expressed"}
    assert {r["panel_gene"] for r in rs.matched_controls(genes, panels, 20, 5, 1).collect()} == {0}


@pytest.mark.parametrize("draw", [rs.thin_counts, rs.thin_units])
def test_thinning_bounds_and_identity(spark, draw):
    seeds = spark.range(40).withColumn("n", F.explode(F.array(F.lit(1), F.lit(3), F.lit(20), F.lit(76))))
    labels = [F.col("id"), F.col("n")]
    out = draw(seeds, "n", F.lit(0.25), labels, "kept").collect()
    assert all(0 <= r["kept"] <= r["n"] for r in out)
    assert sum(r["kept"] for r in out) == pytest.approx(40 * 100 * 0.25, rel=0.1)
    assert all(r["kept"] == r["n"] for r in draw(seeds, "n", F.lit(1.0), labels, "kept").collect())
    again = draw(seeds.repartition(5), "n", F.lit(0.25), labels, "kept")
    assert {(r["id"], r["n"]): r["kept"] for r in again.collect()} == {(r["id"], r["n"]): r["kept"] for r in out}


def test_thinning_violation(spark):
    df = spark.createDataFrame([("g", 3, 6), ("g", 4, 6), ("h", 1, 6)], "s string, n int, total int")
    assert [r["s"] for r in rs.thinning_violations(df, ["s"], "n", "total").collect()] == ["g"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_matched_reference(spark, partitions):
    pdf = pd.DataFrame({"gene_id": [f"G{i:02d}" for i in range(40)], "RGC": np.arange(1.0, 41), "Rod": np.arange(40.0, 0, -1)})
    pdf["is_candidate"] = pdf["gene_id"].isin(["G02", "G30"])
    df = spark.createDataFrame(pdf).repartition(partitions).withColumn("t", F.col("RGC") + F.col("Rod"))
    binned = ranking.quantile_bins(df, "t", ["gene_id"], 2).withColumn("RGC", F.col("RGC") / F.col("t")).withColumn("Rod", F.col("Rod") / F.col("t"))
    result, audit = rs.matched_reference(binned, ["RGC", "Rod"], 50, 9)
    audits = audit.collect()
    assert sum(r["candidate_genes"] for r in audits) == 2 and sum(r["control_genes"] for r in audits) == 38
    rows = {r["class"]: r for r in result.collect()}
    assert all(r["empirical_p"] >= 1 / 51 and r["n_candidates"] == 2 for r in rows.values())
    if not hasattr(test_matched_reference, "seen"):
        test_matched_reference.seen = {c: r["empirical_p"] for c, r in rows.items()}
    assert {c: r["empirical_p"] for c, r in rows.items()} == test_matched_reference.seen


def test_drawn_positions_are_never_sent_to_all_tasks(spark):
    """They grow from a row for each bin, so that Spark takes them for small; the audit draws nothing."""
    binned = spark.range(2000).selectExpr("id AS gene_id", "CAST(id % 4 AS INT) AS bin", "id % 25 = 0 AS is_candidate", "id / 2000.0 AS RGC")
    audit = rs.cut_lineage(rs.reference_audit(binned))
    met = rs.drawn_controls(binned, audit, ["RGC"], 50, 10, 9)
    assert met.count() > 0
    joins = re.findall(r"(\w+Join) \[bin#\w+, _pos", met._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    assert all(r["candidate_genes"] == 20 and r["control_genes"] == 480 and r["sufficient"] for r in audit.collect())


def test_matched_controls_exclude_panels_and_stay_in_bin(spark):
    genes = spark.range(400).select(F.col("id").alias("gene_id"), (F.col("id") % 4).cast("int").alias("bin"))
    panels = spark.createDataFrame([("P", i) for i in range(0, 40)] + [("Q", i) for i in range(20, 60)], "program string, gene_id long")
    pairs = rs.matched_controls(genes, panels, 20, 5, 3).toPandas()
    assert (pairs.groupby(["program", "panel_gene"]).size() == 20).all() and len(pairs) == 80 * 20
    assert pairs["control_gene"].min() >= 60 and ((pairs["control_gene"] % 4) == pairs["bin"]).all()
    assert not pairs.duplicated(["program", "panel_gene", "control_gene"]).any()
    few = rs.matched_controls(genes.filter("gene_id < 76"), panels, 20, 5, 3)
    assert few.count() == 0  # four controls a bin are below the minimum


def test_contrast_weights_equal_nested_means(spark):
    rng = np.random.default_rng(2)
    x = dict(enumerate(rng.random(12)))
    pairs = [("P", g, c) for g in (0, 1, 2) for c in rng.choice(np.arange(5, 12), 3 + g, replace=False)]
    frame = spark.createDataFrame([(p, int(g), int(c)) for p, g, c in pairs], "program string, panel_gene long, control_gene long")
    cube = spark.createDataFrame([(int(g), float(v), "d") for g, v in x.items()], "gene_id long, log1p_cpm double, donor string")
    got = pg.program_scores(cube, pg.contrast_weights(frame), ["donor"]).first()["score"]
    want = np.mean([x[g] - np.mean([x[c] for _, h, c in pairs if h == g]) for g in (0, 1, 2)])
    assert got == pytest.approx(want)


def test_draw_tally_fractions_sum_to_one(spark):
    rows = [(0, "g", "s", "A", "unique"), (1, "g", "s", "B", "unique"), (2, "g", "s", None, "tie"), (3, "g", "s", "B", "unique")]
    winners = spark.createDataFrame(rows, "rep int, gene_id string, scenario string, top_type string, status string")
    base = spark.createDataFrame([("g", "A")], "gene_id string, baseline_top_type string")
    row = rs.draw_tally(winners, base, ["A", "B"], 5).first()
    assert row["modal_type"] == "B" and row["baseline_agreement"] == pytest.approx(0.2)
    assert row["top_fraction_0"] + row["top_fraction_1"] + row["zero_fraction"] + row["tie_fraction"] == pytest.approx(1)


def test_few_strata_are_not_shuffled_by_row(spark):
    """The same sample with the strata sent to all tasks; then no row goes through a shuffle but those of the last buckets."""
    cells = spark.range(3000).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("string").alias("donor"))
    design = rs.sampling_design(cells, ["donor"], {"five": 5}, {"half": 0.5})
    one, two = (rs.sample_cells(cells, design, ["donor"], 2, 1, few=few) for few in (False, True))
    assert {tuple(r) for r in one.select(*sorted(one.columns)).collect()} == {tuple(r) for r in two.select(*sorted(two.columns)).collect()}
    assert one.count() == 2 * 3 * (5 + 500)
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and plan.count("strategy=broadcast") >= 3


def test_units_are_compared_as_text(spark):
    """The kept units are those whose uniform number lies below the fraction, whatever the fraction."""
    rows = [("g", i) for i in (0, 1, 40, 1500)]
    df = spark.createDataFrame(rows, "gene string, n long")
    for fraction in (0.0, 1e-17, 0.1, 0.25, 1 / 3, 1.0):
        got = {r.n: r.kept for r in rs.thin_units(df, "n", F.lit(fraction), [F.lit("s"), F.col("gene")], "kept").collect()}
        want = {n: sum(int(hashlib.md5(f"s|g|{i}".encode()).hexdigest()[:13], 16) / 16**13 < fraction for i in range(1, n + 1)) for _, n in rows}
        assert got == want
