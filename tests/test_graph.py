"""Nearest neighbours, communities and components against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from corrobora.operators import graph as gr
from corrobora.operators import propagation
from corrobora.session import is_stored


def vectors(n=260, dim=6, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (5, dim))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, dim))
    x[: n // 3] = x[0]  # a third of all rows are copies of one
    return x


@pytest.mark.parametrize("pivots,block", [(1, 64), (8, 16), (20, 4096)])
def test_neighbours_are_exact_with_many_copies(spark, pivots, block):
    x, k = vectors(), 7
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)}))
    got = gr.nearest_neighbours(df, "id", "v", k, pivots=pivots, block_rows=block).toPandas().sort_values(["src", "rank"])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert (got["dst"].to_numpy().reshape(-1, k) == want).all()


def test_rows_are_sent_to_blocks_not_to_cells(spark):
    """Where bounds prune nothing, a row visits every cell; it is sent once for each bundle of cells."""
    between = np.abs(np.arange(6)[:, None] - np.arange(6)[None, :]).astype(float)
    bundle, parts = gr._bundled({0: 3, 1: 4, 2: 25, 4: 5, 5: 5}, between, 10)
    assert bundle.tolist() == [0, 0, 1, -1, 2, 2] and parts == [1, 3, 1]
    x = np.random.default_rng(3).uniform(-1, 1, (400, 32))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)}))
    found = gr.nearest_neighbours(df, "id", "v", 5, pivots=20, block_rows=4096)
    got = found.toPandas().sort_values(["src", "rank"])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert (got["dst"].to_numpy().reshape(-1, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
    assert len(got) == 5 * len(x)


def test_neighbours_of_tiny_tables(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert {(r["src"], r["dst"]) for r in gr.nearest_neighbours(df, "id", "v", 5).collect()} == {(1, 2), (2, 1)}
    assert gr.nearest_neighbours(df.limit(0), "id", "v", 5).count() == 0


def test_communities_label_every_vertex_and_repeat(spark):
    edges = [(a, c, 10) for a in range(5) for c in range(a)] + [(a + 10, c + 10, 10) for a in range(5) for c in range(a)] + [(0, 10, 1)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "id long")
    first = {r["id"]: r["community"] for r in gr.communities(nodes, frame, 0.5).collect()}
    again = {r["id"]: r["community"] for r in gr.communities(nodes, frame.repartition(9), 0.5).collect()}
    assert first == again and len(first) == 11 and first[99] == 99
    assert len({first[i] for i in range(5)}) == 1 and len({first[i] for i in range(10, 15)}) == 1


def one_by_one(n, edges, resolution):
    """Labels round by round, and the round whose state came up before."""
    near = {v: {} for v in range(n)}
    for a, c, w in edges:
        if a != c:
            near[a][c] = near[c][a] = max(w, near[a].get(c, 0))
    labels, states = list(range(n)), []
    while labels not in states:
        states.append(labels)
        new = []
        for v in range(n):
            own = int(np.floor(sum(near[v].values()) / len(near[v]) * resolution)) if near[v] else 1
            votes = {labels[v]: own}
            for u, w in near[v].items():
                votes[labels[u]] = votes.get(labels[u], 0) + w
            new.append(max(votes, key=lambda x: (votes[x], -x)))
        labels = new
    return labels, len(states), states[-1] == labels


@pytest.mark.parametrize("edges_at_once", [1 << 20, 40])
def test_resolutions_side_by_side_equal_those_alone(spark, monkeypatch, edges_at_once):
    monkeypatch.setattr(propagation, "EDGES_AT_ONCE", edges_at_once)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(c), int(w)) for a, c, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 2**33, 150))]
    edges += [(70, 71, 5), (71, 70, 9), (72, 72, 4)]
    n, resolutions = 75, [0.0, 0.5, 1.0, 100.0]
    found = gr.communities_by_resolution(spark.range(n), spark.createDataFrame(edges, "src long, dst long, weight long"), resolutions).collect()
    assert len(found) == n * len(resolutions)
    for x in resolutions:
        labels, rounds, settled = one_by_one(n, edges, x)
        own = [r for r in found if r["resolution"] == x]
        assert {r["id"]: r["community"] for r in own} == dict(enumerate(labels))
        assert {(r["rounds"], r["settled"]) for r in own} == {(rounds, settled)}
    assert len({r["settled"] for r in found}) == 2


def test_neighbours_and_communities_are_made_once_a_run(spark):
    folder = "/root/testdata/sf0.001"
    contract.queries()["graph_communities"](spark, folder).count()
    assert is_stored(spark, folder, "neighbours") and is_stored(spark, folder, "communities")


def test_components_match_numpy(spark):
    x = vectors(120, 5)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)}))
    scores, ratio = gr.principal_components(df, "id", "v", 3)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    np.testing.assert_allclose([r["variance_ratio"] for r in ratio.orderBy("component").collect()], (s**2 / (s**2).sum())[:3], rtol=1e-8)
    mine = np.array([r["components"] for r in scores.orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(mine), np.abs(c @ vt[:3].T), atol=1e-8)
