"""Components of sparse counts against NumPy's dense decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from corrobora.operators import components as co


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    dense = rng.poisson(0.3, (300, 40)) * rng.gamma(2.0, 1.0, (300, 40))
    dense[:, :5] += np.outer(rng.normal(4, 2, 300), [3, 2, 1, 0, 0]).clip(0)
    dense[7] = 0
    entries = [(int(i), int(j) * 3, float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    values = spark.createDataFrame([*entries, (0, 1, 9.0), (999, 3, 5.0)], "cell_id long, gene_id long, v double").repartition(7)
    cells = spark.range(300).withColumnRenamed("id", "cell_id")
    genes = spark.createDataFrame([(3 * j,) for j in range(40)], "gene_id long")
    return dense, *co.sparse_rows(values, cells, genes, "cell_id", "gene_id", "v")


def test_rows_hold_what_counts(table):
    dense, rows, names = table
    assert names == [3 * j for j in range(40)]
    got = np.zeros_like(dense)
    for r in rows.collect():
        got[r["cell_id"], r["at"]] = r["x"]
    assert np.allclose(got, dense) and rows.count() == 300


@pytest.mark.parametrize("k", [3, 40])
def test_components_equal_a_dense_decomposition(table, k, monkeypatch):
    monkeypatch.setattr(co, "FULL_WIDTH", 0)
    dense, rows, _ = table
    centred = dense - dense.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    directions, shares, mean, passes = co.components(rows, 40, k, 1)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:k], atol=1e-7) and np.allclose(mean, dense.mean(axis=0))
    assert passes <= co.MAX_PASSES and (passes == 1) == (k == 40)
    top = 1 if k == 3 else 3
    assert np.allclose(np.abs(directions[:, :top].T @ vt[:top].T), np.eye(top), atol=1e-3)
    found = {r["cell_id"]: r["components"] for r in co.scores(rows, "cell_id", directions, mean).collect()}
    own = np.array([found[i] for i in range(300)])
    assert np.allclose(own, centred @ directions) and np.allclose(own.mean(axis=0), 0, atol=1e-9)


def test_no_cells(spark, table):
    _, rows, _ = table
    directions, shares, _, _ = co.components(rows.limit(0), 40, 3, 1)
    assert directions.shape == (40, 0) and len(shares) == 0
