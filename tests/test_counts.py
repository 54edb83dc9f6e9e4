"""Counts, pseudobulk, contracts and text scans on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corrobora.functions.strings import has_token, tokens
from corrobora.operators import contracts, counts as ops, evidence as ev, intervals as iv, ranking
from corrobora.sources import tables, text


def test_pseudobulk_missing_is_not_zero(spark):
    cells = [("c1", "R1", True, 10), ("c2", "R1", False, 10), ("c3", "R2", True, 10), ("c4", "R2", True, 10), ("c5", "R3", True, 10), ("c6", "R3", True, 10)]
    frame = spark.createDataFrame([(c, d, "A", s, t) for c, d, s, t in cells], "cell_id string, donor string, cell_type string, qc_strict boolean, total long").withColumn("qc_primary", F.lit(True))
    g = [1, 0, 2, 0, 0, 0]
    rows = [(c[0], "G", n) for c, n in zip(cells, g) if n] + [(c[0], "background", 10 - n) for c, n in zip(cells, g)]
    counts = spark.createDataFrame(rows, "cell_id string, gene_id string, umi int")
    genes = spark.createDataFrame([("G", True), ("absent", False)], "gene_id string, gene_in_matrix boolean")
    cube = ops.pseudobulk(ops.gene_sums(counts, frame), ops.group_totals(frame), genes, ["R1", "R2", "R3"], ["A", "B"], 2)
    at = {(r["qc"], r["donor"], r["cell_type"], r["gene_id"]): r for r in cube.collect()}
    assert len(at) == 2 * 3 * 2 * 2
    assert at["primary", "R1", "A", "G"]["cpm"] == pytest.approx(50000)
    assert at["primary", "R3", "A", "G"]["cpm"] == 0
    assert at["primary", "R1", "B", "G"]["cpm"] is None and at["primary", "R1", "B", "G"]["n_cells"] == 0
    assert at["primary", "R1", "A", "absent"]["sum_gene_umis"] is None
    assert at["strict", "R1", "A", "G"]["status"] == "below_minimum"
    means = {(r["qc"], r["cell_type"], r["gene_id"]): r for r in ops.balanced_means(cube).collect()}
    assert means["strict", "A", "G"]["eligible_donors"] == 2


def test_shared_types_need_every_donor(spark):
    totals = spark.createDataFrame([("primary", "R1", "A", 20), ("primary", "R2", "A", 25), ("primary", "R1", "B", 99)], "qc string, donor string, cell_type string, n_cells int")
    assert [r["cell_type"] for r in ops.shared_types(totals, ["R1", "R2"], ["A", "B"], 20).collect()] == ["A"]


def test_evidence_agreement_is_per_context(spark):
    def rec(method, qtl, tissue):
        return ("L1", "ENSG1", "GENE1", qtl, tissue, method, 0.8, True, True, True)

    rows = [rec("x", "eQTL", "Retina"), rec("y", "eQTL", "Brain"), rec("x", "eQTL", "Brain"), rec("y", "sQTL", "Retina")]
    df = spark.createDataFrame(rows, "locus string, gene_id string, gene string, qtl_type string, tissue string, method string, score double, qc_pass boolean, baseline_pass boolean, strict_pass boolean")
    wide = {(r["qtl_type"], r["tissue"]): r for r in ev.evidence_matrix(df, ["x", "y"]).collect()}
    agree = [k for k, r in wide.items() if r["baseline_same_context_agreement"]]
    assert agree == [("eQTL", "Brain")]
    assert wide["eQTL", "Retina"]["y_score"] is None and wide["eQTL", "Retina"]["y_baseline_pass"] is False
    counts = {r["rule"]: (r["loci"], r["genes"], r["locus_gene_pairs"], r["qtl_tissue_contexts"]) for r in ev.rule_counts(ev.evidence_matrix(df, ["x", "y"])).collect()}
    assert counts["baseline_union"] == (1, 1, 1, 3) and counts["strict_same_context_agreement"] == (1, 1, 1, 1)


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([("x", 0.5, True), ("x", 0.51, True), ("x", 0.9, False)], "method string, score double, qc_pass boolean")
    out = [r["baseline_pass"] for r in ev.flag_thresholds(df, {"x": 0.5}, {"x": 0.5}).orderBy("score").collect()]
    assert out == [False, True, False]


def test_labels_are_audited_not_repaired(spark):
    df = spark.createDataFrame([(2, "GENE1", True), (3, "2001-09-01", False), (4, "2001-03-01", False)], "source_row int, label string, is_text boolean")
    kept, audit = contracts.label_audit(df, "label", F.col("is_text"), "not text")
    assert [r["label"] for r in kept.collect()] == ["GENE1"]
    assert sorted(r["source_row"] for r in audit.collect()) == [3, 4]
    twice = kept.unionByName(kept)
    assert contracts.duplicate_keys(twice, ["label"]).first()["n_rows"] == 2


def test_wide_count_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cellA,cellB\nGENE1,0,2\nGENE2,3,0\nSHORT,1\nNEG,-1,2\n")
    counts, bad = text.read_wide_counts(spark, str(tmp_path / "m.csv"))
    assert {tuple(r) for r in counts.collect()} == {("cellB", "GENE1", 2), ("cellA", "GENE2", 3)}
    assert {tuple(r) for r in bad.collect()} == {("SHORT", "width"), ("NEG", "count")}


def test_wide_count_text_keeps_good_rows_beside_bad_ones(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",cellA,cellB,cellA\nG1,1,2,3\nG2,x,5,1\nG3,4,4,4\nG3,1,1,1\n")
    counts, bad = text.read_wide_counts(spark, str(tmp_path / "m.csv"))
    assert {tuple(r) for r in counts.collect()} == {("cellB", "G1", 2)}
    assert {tuple(r) for r in bad.collect()} == {("G2", "count"), ("G3", "repeated_gene"), ("cellA", "repeated_cell")}
    (tmp_path / "n.csv").write_text("G1,1\nG2,2\n")
    named, _ = text.read_wide_counts(spark, str(tmp_path / "n.csv"), names=["c"])
    assert {tuple(r) for r in named.collect()} == {("c", "G1", 1), ("c", "G2", 2)}
    (tmp_path / "none.csv").write_text("")
    assert all(df.count() == 0 for df in text.read_wide_counts(spark, str(tmp_path / "none.csv")))


def test_triplet_faults_are_counted(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n9 9 4\nzz 2 7\n0 1 1\n1 1 5\n1 1 5\n")
    check = text.read_triplets(spark, str(tmp_path / "m.mtx"))[1].first()
    assert (check.n_entries, check.n_invalid, check.n_repeated, check.consistent) == (4, 2, 2, False)


def test_delimited_header_stands_once(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\na\tb\n1\t2.50\n")
    good, bad = text.read_delimited(spark, str(tmp_path / "t.tsv"), "a string, b decimal(10,2)")
    assert [str(r["b"]) for r in good.collect()] == ["2.50"] and bad.count() == 1


def test_fingerprints_see_where_a_value_is_missing(spark):
    schema = "a string, b string"
    one, two = (spark.createDataFrame([x], schema) for x in (("x", None), (None, "x")))
    assert contracts.fingerprint(one).first() != contracts.fingerprint(two).first()
    line = lambda: contracts.canonical_line({"a": F.col("a"), "b": F.col("b")})
    rows = [("x", None), (None, "x"), ("", None), (None, ""), ("1|b=1:2", None), ("1", "2")]
    digests = {contracts.text_fingerprint(spark.createDataFrame([x], schema), line()).first()["digest_xor"] for x in rows}
    assert len(digests) == len(rows)


def test_missing_values_take_no_part_in_ranks(spark):
    p = spark.createDataFrame([("a", None), ("b", 0.01), ("c", 0.04)], "k string, p double")
    assert {r["k"]: r["q"] for r in ranking.benjamini_hochberg(p, "p", ["k"]).collect()} == {"a": None, "b": 0.02, "c": 0.04}
    pairs = [(1.0, 2.0), (2.0, 1.0), (3.0, 2.0), (0.5, None), (None, 3.0)]
    rho = ranking.spearman(spark.createDataFrame([("g", *x) for x in pairs], "g string, x double, y double"), ["g"], "x", "y").first()
    assert rho.n == 3 and abs(rho.spearman) < 1e-12


def test_triplets(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n2 3 3\n1 1 5\n2 3 7\n1 2 1\n")
    entries, check = text.read_triplets(spark, str(tmp_path / "m.mtx"))
    assert {tuple(r) for r in entries.collect()} == {(1, 1, 5), (2, 3, 7), (1, 2, 1)}
    assert check.first()["consistent"]
    (tmp_path / "w.mtx").write_text("%%MatrixMarket\n2 3 4\n1 1 5\n2 4 7\n")
    assert not text.read_triplets(spark, str(tmp_path / "w.mtx"))[1].first()["consistent"]


def test_delimited_with_title_line(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Table S6: peaks\npeak\tp\nchr1-5-9\t0.5\nchr1-7-9\toops\n")
    good, bad = text.read_delimited(spark, str(tmp_path / "t.tsv"), "peak string, p double", junk="^Table ")
    assert [tuple(r) for r in good.collect()] == [("chr1-5-9", 0.5)] and bad.count() == 1


def test_tokens(spark):
    df = spark.createDataFrame([("PSMC3, NPC2",), ("PSMC3IP, NPC2",), (None,)], "t string")
    out = [(r["h"], r["n"]) for r in df.select(has_token(F.col("t"), F.lit("PSMC3")).alias("h"), F.size(tokens(F.col("t"))).alias("n")).collect()]
    assert out == [(True, 2), (False, 2), (False, 0)]
    labels = spark.createDataFrame([("OFF, ON, Micro",), ("ON, ?",)], "t string")
    rows = iv.canonical_labels(labels, "t", {"OFF": "Bipolar", "ON": "Bipolar", "Micro": "Microglia"}, "c").collect()
    assert rows[0]["c"] == ["Bipolar", "Microglia"] and rows[0]["unknown_labels"] == [] and rows[1]["unknown_labels"] == ["?"]


def test_point_in_interval(spark):
    points = spark.createDataFrame([("a", "c1", 10), ("b", "c1", 20), ("c", "c2", 15), ("d", "c1", 5000), ("e", "c1", 10)], "rsid string, chrom string, pos long")
    spans = spark.createDataFrame([(1, "c1", 10, 20), (2, "c1", 0, 100000), (3, "c1", 7, 7)], "id int, chrom string, start long, end long")
    got = sorted((r["rsid"], r["id"]) for r in iv.point_in_interval(points, spans, 16).collect())
    assert got == [("a", 1), ("a", 2), ("b", 2), ("d", 2), ("e", 1), ("e", 2)]


@pytest.mark.parametrize("width", [1, 3, 16, 5000])
def test_interval_join_equals_plain_comparison(spark, width):
    points = spark.range(300).select(F.col("id").alias("p"), F.lit("c").alias("chrom"), (F.xxhash64("id") % 500).alias("pos"))
    spans = spark.range(120).select(F.col("id").alias("i"), F.lit("c").alias("chrom"), (F.xxhash64(-F.col("id")) % 500).alias("start")).withColumn("end", F.col("start") + F.pmod(F.xxhash64("start"), F.lit(200)))
    got = {(r["p"], r["i"]) for r in iv.point_in_interval(points, spans, width).collect()}
    pts, sps = points.collect(), spans.collect()
    assert got == {(x["p"], y["i"]) for x in pts for y in sps if y["start"] <= x["pos"] < y["end"]}


def test_reconciliation_and_fingerprint(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "k int, v double")
    z = spark.createDataFrame([(1, 1.0 + 1e-12), (2, None), (4, 5.0)], "k int, v double")
    row = contracts.reconcile_results(a, z, ["k"], ["v"], 1e-10).first()
    assert (row["n_keys"], row["n_one_sided"], row["n_outside_tolerance"]) == (4, 2, 0)
    first = contracts.fingerprint(a).first()
    assert contracts.fingerprint(a.repartition(5).orderBy(F.desc("k"))).first() == first
    assert contracts.fingerprint(a.unionByName(a)).first() != first
    assert contracts.fingerprint(z).first() != first


def test_create_only_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 / 3)], "k int, v double")
    tables.write_new_parquet(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_new_parquet(df, str(tmp_path / "t"))
    tables.write_new_text(df, str(tmp_path / "c"))
    assert "0.333333333333" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "c")).collect())


def test_registry_statuses(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    digest = hashlib.sha256(b"x").hexdigest()
    declared = spark.createDataFrame([("a.txt", digest, 1), ("b.txt", digest, 1), ("gone.txt", digest, 1)], "file string, sha256 string, bytes long")
    out = {r["file"]: r["status"] for r in tables.source_registry(spark, str(tmp_path), declared).collect()}
    assert out == {"a.txt": "verified", "b.txt": "digest_mismatch", "gone.txt": "missing_file"}


def test_join_cardinality_names_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    told = lambda expect: {tuple(r) for r in contracts.join_cardinality(left, right, ["k"], expect).collect()}
    assert told("many_to_one") == {("right", 2, 2)}
    assert told("one_to_many") == {("left", 1, 2)}
    assert told("one_to_one") == {("left", 1, 2), ("right", 2, 2)}


def test_highest_class_prefers_declared_order(spark):
    df = spark.createDataFrame([("g", "B", 2.0), ("g", "A", 2.0), ("h", "B", -1.0), ("h", "A", -2.0)], "gene_id string, class string, value double")
    assert {r["gene_id"]: r["highest_class"] for r in ev.highest_class(df, ["A", "B"]).collect()} == {"g": "A", "h": "B"}
    assert ranking.TIE_TOLERANCE == 1e-10


def test_a_gene_of_the_cube_stays_in_one_task(spark):
    """Who groups the cube by gene needs no shuffle of its rows: a gene meets its sums once, not once a group."""
    rows = [(f"D{i % 3}", f"T{i % 2}", g, *[i] * 6) for g in range(40) for i in range(6)]
    names = ", ".join(f"_{c}_{t} long" for t in ops.TIERS for c in "gdx")
    sums = spark.createDataFrame(rows, f"donor string, cell_type string, gene_id long, {names}")
    genes = spark.range(50).select(F.col("id").alias("gene_id"), (F.col("id") < 45).alias("gene_in_matrix"))
    totals = spark.createDataFrame([(q, f"D{i}", f"T{j}", 30, 100) for q in ops.TIERS for i in range(3) for j in range(2)], "qc string, donor string, cell_type string, n_cells long, sum_all long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        cube = ops.pseudobulk(sums, totals, genes, ["D0", "D1", "D2"], ["T0", "T1"], 2).withColumn("task", F.spark_partition_id())
        told = cube.groupBy("gene_id").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n"), F.sum("sum_gene_umis").alias("g")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {(r.tasks, r.n) for r in told} == {(1, 12)} and len(told) == 50
    assert {r.g for r in told if r.gene_id < 40} == {30} and {r.g for r in told if r.gene_id >= 45} == {None}


def test_values_that_carry_their_batch_meet_no_cells_again(spark):
    cells = spark.createDataFrame([(i, f"L{i % 2}", 10 + i) for i in range(30)], "cell_id long, library string, total long")
    counts = spark.createDataFrame([(i, g, 1 + (i * g) % 5) for i in range(30) for g in range(1, 6)], "cell_id long, gene_id long, umi long")
    genes = spark.createDataFrame([(g,) for g in range(1, 6)], "gene_id long")
    one, two = (ops.variable_genes(ops.normalise(counts, cells, carry=c), cells, genes, 3).collect() for c in ([], ["library"]))
    assert [(r.gene_id, r.n_batches) for r in one] == [(r.gene_id, r.n_batches) for r in two] and len(two) == 3
