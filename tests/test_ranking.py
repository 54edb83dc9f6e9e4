"""Ranks, adjusted p-values, winners and leave-one-out on small fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrobora.functions.numeric import minus_log10, rounded
from corrobora.operators import ordering, ranking


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03)], "family string, id int, p double")
    out = {r["id"]: r["q"] for r in ranking.benjamini_hochberg(df, "p", ["id"], ["family"]).collect()}
    assert out == pytest.approx({1: 0.03, 2: 0.04, 3: 0.04})


def skewed(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "family": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n)),
            "id": np.arange(n),
            "p": np.round(rng.random(n), 2),
        }
    )


@pytest.mark.parametrize("partitions", [1, 13])
def test_adjusted_p_values_in_a_hot_family(spark, partitions):
    pdf = skewed()
    df = spark.createDataFrame(pdf).repartition(partitions)
    got = ranking.benjamini_hochberg(df, "p", ["id"], ["family"]).toPandas().set_index("id")["q"]
    for _, group in pdf.groupby("family"):
        v = group.sort_values(["p", "id"])
        raw = v["p"].to_numpy() * len(v) / np.arange(1, len(v) + 1)
        q = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
        np.testing.assert_allclose(got.loc[v["id"]].to_numpy(), q, rtol=1e-12)


def test_rank_running_total_and_average_rank_match_pandas(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    order = [F.col("p"), F.col("id")]
    rank = ordering.rank_in_group(df, ["family"], order, "rank", "size").toPandas().sort_values("id")
    want = pdf.sort_values(["family", "p", "id"]).groupby("family").cumcount() + 1
    assert (rank["rank"].to_numpy() == want.sort_index().to_numpy()).all()
    assert (rank["size"].to_numpy() == pdf.groupby("family")["id"].transform("size").to_numpy()).all()
    total = ordering.running_total(df, ["family"], order, "p", "total").toPandas().sort_values("id")
    want = pdf.sort_values(["family", "p", "id"]).groupby("family")["p"].cumsum().sort_index()
    np.testing.assert_allclose(total["total"].to_numpy(), want.to_numpy(), rtol=1e-12)
    avg = ordering.average_rank(df, ["family"], "p", "r").toPandas().sort_values("id")
    np.testing.assert_allclose(avg["r"].to_numpy(), pdf.groupby("family")["p"].rank().to_numpy())


@pytest.mark.parametrize("n,q", [(40, 2), (101, 10), (57, 7)])
def test_quantile_bins_match_pandas(spark, n, q):
    values = np.random.default_rng(n).random(n).round(2)
    pdf = pd.DataFrame({"id": np.arange(n), "v": values})
    got = ranking.quantile_bins(spark.createDataFrame(pdf), "v", ["id"], q).toPandas().sort_values("id")["bin"]
    want = pd.qcut(pdf["v"].rank(method="first"), q=q, labels=False)
    assert (got.to_numpy() == want.to_numpy()).all()


def test_winner_codes(spark):
    rows = [(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [3.0, 2.0]), (4, [None, 2.0]), (5, [float("nan"), 2.0]), (6, [1.0, 1.0 + 1e-11])]
    df = spark.createDataFrame(rows, "id int, scores array<double>")
    out = {r["id"]: (r["status"], r["top_type"]) for r in ranking.unique_winner(df, ["A", "B"]).collect()}
    assert out == {
        1: ("tie", None),
        2: ("no_UMIs", None),
        3: ("unique", "A"),
        4: ("insufficient_groups", None),
        5: ("insufficient_groups", None),
        6: ("tie", None),
    }
    text = {r["id"]: (r["status"], r["top_type"]) for r in ranking.joined_winners(df, ["A", "B"]).collect()}
    assert text[1] == ("tie", "A;B") and text[2] == ("no_detected_UMIs", None) and text[3] == ("unique", "A")


def lodo_frame(spark):
    rows = []
    for donor, a, b in (("R1", 8.0, 2.0), ("R2", 1.0, 4.0), ("R3", 8.0, 2.0)):
        rows += [("G", donor, "A", 20, a), ("G", donor, "B", 2000, b), ("G", donor, "Rare", 19, 99.0)]
    return spark.createDataFrame(rows, "gene_id string, donor string, cell_type string, n_cells int, score double")


def test_leave_one_out_keeps_equal_weights_and_a_fixed_set(spark):
    donors = ["R1", "R2", "R3"]
    df = lodo_frame(spark)
    scores = ranking.comparisons(df, ["gene_id"], ["A", "B"], {"all": donors}, F.col("score")).first()["scores"]
    assert scores[0] == pytest.approx(17 / 3)
    out = ranking.stability(df, ["gene_id"], ["A", "B"], donors, F.col("score")).first()
    assert out["top_type"] == "A" and out["agreeing_folds"] == 3 and out["all_folds_agree"]
    wide = ranking.stability(df, ["gene_id"], ["A", "B", "Rare"], donors, F.col("score")).first()
    assert wide["top_type"] == "Rare"


def test_spearman_matches_pandas_and_guards_constants(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["x"] * 50 + ["y"] * 5, "a": list(rng.integers(0, 9, 50)) + [1] * 5, "b": list(rng.integers(0, 9, 50)) + [1, 2, 3, 4, 5]}).astype({"a": float, "b": float})
    out = {r["g"]: r["spearman"] for r in ranking.spearman(spark.createDataFrame(pdf), ["g"], "a", "b").collect()}
    x = pdf[pdf.g == "x"]
    assert out["x"] == pytest.approx(x["a"].rank().corr(x["b"].rank()))
    assert out["y"] is None
    pair = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0], [3.0, 1.0, 4.0, 9.0]), ([1.0, 1.0], [1.0, 2.0])], "l array<double>, r array<double>")
    rho = [r["rho"] for r in ranking.array_spearman(pair, "l", "r", "rho").collect()]
    want = pd.Series([1, 2, 2, 5]).rank().corr(pd.Series([3, 1, 4, 9]).rank())
    assert rho[0] == pytest.approx(want) and rho[1] is None


def test_declared_order_keeps_missing_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int")
    assert [(r["k"], r["v"]) for r in ranking.declared_order(df, "k", ["a", "x", "b"]).collect()] == [("a", 2), ("x", None), ("b", 1)]


def test_minus_log10_of_zero_is_infinite(spark):
    rows = spark.createDataFrame([(0.0,), (0.01,), (1.0,), (None,)], "p double").select(rounded(minus_log10(F.col("p"))).alias("x"))
    assert [r["x"] for r in rows.collect()] == [float("inf"), 2.0, 0.0, None]
