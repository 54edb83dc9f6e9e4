"""Evidence matrix pieces: absent layers, unknown criteria, counts of layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.operators import screening as sc


def test_matrix_keeps_layers_apart_and_unknown_is_not_met(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "gene_id long")
    a = spark.createDataFrame([(1, True, 0.95), (2, True, None)], "gene_id long, same boolean, least double")
    b = spark.createDataFrame([(1, 4)], "gene_id long, n int")
    out = sc.evidence_matrix(entities, {"a": a, "b": b}, "gene_id", ["same"], ["n"], [F.col("same"), F.col("least") >= 0.9])
    got = {r["gene_id"]: (r["same"], r["least"], r["n"], r["screening_flag"]) for r in out.collect()}
    assert got == {1: (True, 0.95, 4, True), 2: (True, None, 0, False), 3: (False, None, 0, False)}
    report = sc.criteria_report(out, "gene_id", {"x": F.col("same"), "y": F.col("least") >= 0.9}).collect()
    assert {r["gene_id"]: (r["x"], r["y"], r["n_met"]) for r in report} == {1: (True, True, 2), 2: (True, False, 1), 3: (False, False, 0)}
    assert {r["name"]: r["genes"] for r in sc.funnel(out, {"all": F.lit(True), "known": F.col("least") > 0}).collect()} == {"all": 3, "known": 1}


def test_layer_counts(spark):
    pairs = spark.createDataFrame([(1, 7, True, None), (2, 7, True, False), (3, 8, False, True)], "v long, g long, contact boolean, eqtl boolean")
    got = {r["g"]: (r["n_contact"], r["n_eqtl"]) for r in sc.layer_counts(pairs, "g", ["contact", "eqtl"]).collect()}
    assert got == {7: (2, 0), 8: (0, 1)}


def test_only_the_asked_points_meet_intervals(spark):
    """The evidence matrix asks for few points; all others would only be thrown away after the join."""
    from corrobora.plans import intervals

    folder = "/root/testdata/sf0.001"
    known = spark.range(20).withColumnRenamed("id", "variant_id")
    rows = lambda df: sorted(map(tuple, df.select("variant_id", "peak_id", "label").collect()))
    some = intervals.hits(spark, folder, known)
    assert rows(some) == rows(intervals.hits(spark, folder).filter("variant_id < 20")) and some.count() >= 20
