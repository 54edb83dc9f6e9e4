"""Approximate neighbours against brute force: recall, copies, hot blocks, odd rows and growth of the work."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from corrobora.operators import graph as gr
from corrobora.operators import neighbours as nb

K = 5


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)}))


def brute(x, k=K):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def of(df):
    return df.toPandas().sort_values(["src", "rank"])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 4, (40, 12))[rng.integers(0, 40, 1500)] + rng.normal(0, 1, (1500, 12))
    x[:500] = x[0]  # a third of all rows are copies of one
    return x


def test_recall_ranks_and_copies(spark, clustered):
    got = of(nb.approximate_neighbours(frame(spark, clustered), "id", "v", K, tables=8, probes=8, bucket_rows=64))
    want = brute(clustered)
    hits = sum(len(set(g["dst"]) & set(want[s])) for s, g in got.groupby("src"))
    assert hits >= 0.95 * want.size
    copies = got[got["src"] < 500]
    assert (copies["dst"].to_numpy().reshape(-1, K) == want[:500]).all() and (copies["distance"] == 0).all()
    assert (got["src"] != got["dst"]).all() and got.groupby("src")["rank"].max().eq(K).all()
    apart = np.sqrt(((clustered[got["src"]] - clustered[got["dst"]]) ** 2).sum(axis=1))
    np.testing.assert_allclose(got["distance"], apart, rtol=1e-12)


def test_all_buckets_probed_is_exact_and_hot_blocks_lose_nothing(spark, clustered, monkeypatch):
    x = clustered[400:900]
    want = brute(x)
    run = lambda **kw: of(nb.approximate_neighbours(frame(spark, x), "id", "v", K, tables=2, **kw))
    whole = run(probes=1, bucket_rows=10_000)
    assert (whole["dst"].to_numpy().reshape(-1, K) == want).all()
    # Blocks of one bucket and a tenth of the rows are hot, and dealt to several tasks.
    monkeypatch.setattr(nb, "BLOCK_BUCKETS", 1)
    dealt = run(probes=64, bucket_rows=8)
    assert (dealt["dst"].to_numpy().reshape(-1, K) == want).all()


def test_queries_are_a_part_of_the_rows(spark, clustered):
    df = frame(spark, clustered)
    few = df.filter("id % 20 = 0").select("id")
    found = nb.approximate_neighbours(df, "id", "v", K, bucket_rows=64, queries=few)
    truth = gr.nearest_neighbours(df, "id", "v", K, queries=few)
    row = nb.recall(found, truth).first()
    assert row["n_true"] == 75 * K and row["recall"] >= 0.95
    assert nb.recall(found.limit(0), truth.limit(0)).first()["recall"] == 1.0


def test_odd_rows_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [0.0, 0.5]), (7, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["src"], r["dst"], r["distance"], r["rank"]) for r in nb.approximate_neighbours(df, "id", "v", K).collect()}
    assert got == {(1, 2, 1.0, 1), (2, 1, 1.0, 1)}
    assert nb.approximate_neighbours(df.limit(0), "id", "v", K).count() == 0
    assert nb.approximate_neighbours(df.filter("id = 1"), "id", "v", K).count() == 0


def test_work_grows_slower_than_the_square():
    """Vectors that a query meets, at two sizes of which one has eight times the rows of the other."""
    rng = np.random.default_rng(3)
    met = []
    for n in (4_000, 32_000):
        x = rng.normal(size=(n, 16))
        index = nb.Projections.fitted(x[: nb.SAMPLE_ROWS], 4, int(np.ceil(np.log2(n / 128))), 1)
        sizes = [np.bincount(index.homes(t, x), minlength=1 << index.bits) for t in range(4)]
        met.append(np.mean([sizes[t][index.probes(t, x[:200], 8)].sum(axis=1).mean() for t in range(4)]))
    assert met[1] < 1.5 * met[0]


def test_probes_are_added_until_the_goal_is_reached(spark):
    """Uniform vectors in many dimensions, small buckets and one probe: without more probes most neighbours would be missed."""
    x = np.random.default_rng(5).uniform(-1, 1, (3000, 32))
    want = brute(x)
    got = of(nb.approximate_neighbours(frame(spark, x), "id", "v", K, tables=4, probes=1, bucket_rows=32))
    hits = sum(len(set(g["dst"]) & set(want[s])) for s, g in got.groupby("src"))
    assert hits >= 0.94 * want.size


def nearest_listed(ids, x, qids, q, k):
    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    d[qids[:, None] == ids[None, :]] = np.inf
    return [(int(a), int(ids[j]), float(d[i, j])) for i, a in enumerate(qids) for j in np.lexsort((ids, d[i]))[:k]]


@pytest.mark.parametrize("kind", ["uniform", "far from the origin", "copies", "tiny", "huge", "few"])
def test_pairs_chosen_in_single_precision_are_the_nearest(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (700 if kind == "few" else 5003, 9))
    x = {"far from the origin": x * 0.01 + 1000, "tiny": x * 1e-25, "huge": x * 1e30}.get(kind, x)
    if kind == "copies":
        x[rng.permutation(len(x))[:3000]] = x[0]
        x[rng.permutation(len(x))[:20]] = x[1]
    ids = rng.permutation(len(x)) + 100
    some = np.unique(rng.integers(0, len(x), 300))
    found = [np.concatenate(c).tolist() for c in zip(*nb.nearest_pairs(ids, x, ids[some], x[some], 7))]
    want = nearest_listed(ids, x, ids[some], x[some], 7)
    assert sorted(zip(*found)) == sorted(want)
    bounds = np.array([want[7 * i + 6][2] for i in range(len(some))])
    half = np.isin(ids, [w[1] for w in want]) | (ids % 9 == 0)
    for among in (half, np.ones(len(x), bool)):
        held = [np.concatenate(c).tolist() for c in zip(*nb.Searched(ids, x).nearest(ids[some], x[some], 7, bounds, among))]
        assert sorted(zip(*held)) == sorted(want)


def test_few_pairs_are_measured():
    x = np.random.default_rng(5).normal(0, 1, (40_000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    searched = nb.Searched(np.arange(len(x)), x)
    row, _ = searched._chosen(x[:256], 15, np.full(256, np.inf), searched.columns)
    assert 16 * 256 <= len(row) < 18 * 256
