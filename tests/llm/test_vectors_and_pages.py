"""Search and URL filters against brute force, and the pipeline against its parts."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from corrobora.llm import queries, search, urls
from corrobora.llm.components import components


def vectors(n: int, dims: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, dims))
    out = [(i, (centres[i % 5] + rng.normal(0, 0.1, dims)).tolist()) for i in range(n)]
    out += [(n + i, out[0][1]) for i in range(n // 3)]
    out += [(5 * n, None), (5 * n + 1, [None] * dims), (5 * n + 2, [float("nan")] * dims), (5 * n + 3, [float("inf")] * dims)]
    return [*out, (None, out[1][1]), out[2], (5 * n + 20 - 5 * n % 20, [0.5] * (dims + 1)), (5 * n + 21, [0.5] * (dims + 1))]


@pytest.mark.parametrize(("n", "rows", "asked"), [(900, 64, 16), (30, 2048, 512)])
def test_search(spark, monkeypatch, n, rows, asked):
    monkeypatch.setattr(search, "CELL_ROWS", rows)
    monkeypatch.setattr(search, "QUERY_ROWS", asked)
    data = vectors(n, 8, 1)
    held = search.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    found = search.top_k(held, held.filter("vec_id % 20 = 0"), 20).collect()
    good = {d: np.floor(64 * np.array(v, np.float32).astype(np.float64)) for d, v in data if d is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            scored = sorted((-int(good[q] @ v), d) for d, v in good.items() if d != q and len(v) == len(good[q]))
            want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(scored[:20])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(want)


def test_search_of_nothing(spark):
    none = search.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert search.top_k(none, none, 20).count() == 0


def test_cover_tree_covers():
    points = np.floor(np.random.default_rng(2).normal(0, 20, (700, 6)))
    points[300:] = points[299]
    order, nodes = search.cover_tree(points)
    assert sorted(order) == list(range(700))
    for centre, radius, begin, end, children in nodes:
        away = np.sqrt(((points[order[begin:end]] - centre) ** 2).sum(axis=1))
        assert away.max() <= radius + 1e-9
        assert not children or sum(nodes[c][3] - nodes[c][2] for c in children) == end - begin


def test_components(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 7), (2000, 2000)]
    edges += [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(150)] * 2
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGES = [
    (1, "http://a.example.com/x", '<html><link rel="canonical" href="https://bad.net/p"></html>'),
    (2, "https://A.example.com/y?q=1#f", "<link href='/x' rel='canonical'>"),
    (3, "http://b.example.com/", '<META content="0; URL=http://a.example.com/x" http-equiv="refresh">'),
    (4, "http://example.net/en/ok", '<link rel=canonical href=//bad.net/p>'),
    (5, "http://deep.org/fr/ok", '<link rel="canonical" href="http://bad.net/p">'),
    (6, "http://deep.org/de/page", '<link rel="canonical" href="sub/other">'),
    (7, "http://example.com/de/x", "nothing"),
    (8, "http://example.com/d", '<link rel="stylesheet" href="http://bad.net/p">'),
    (9, None, '<link rel="canonical" href="http://bad.net/p">'),
    (10, "no scheme", None),
    (11, "", None),
    (12, "http://notexample.net/en/", None),
    (13, "http://net", None),
    (14, "http://x.example.net?en/", None),
    (15, "http://c.example.com/to", None),
    (16, "http://c.example.com/to", None),
    (17, "http://e.example.com/esc", '<link rel="canonical" href="http://bad.net/s?a=1&amp;b=2">'),
    (18, "http://e.example.com/esc2", '<link rel="canonical" href="http:&#47;&#x2F;bad.net/q">'),
    (19, "http://f.example.com/a/b/c", '<link rel="canonical" href="../p">'),
    (20, "http://f.example.com/a/p", '<link rel="canonical" href="http://bad.net/">'),
    (21, "http://f.example.com/a/x/../p", None),
    (22, "http://g.example.com/list?page=1", '<link rel="canonical" href="?page=2">'),
    (23, "http://g.example.com/list?page=2", '<meta http-equiv="refresh" content="0;url=http://bad.net">'),
    (24, "http://h.example.com", '<link rel="canonical" href="http://bad.net/h">'),
    (25, "http://h.example.com/", None),
    (26, "http://i.example.com/m", '<link rel="canonical" href="mailto:a@bad.net"><link rel="canonical" href="/go?to=http://bad.net/p">'),
    (27, "http://i.example.com/n", '<link rel="canonical" href="#top">'),
    (28, "http://example.com/en/../de/", None),
    (29, "http://j.example.com/..", '<link rel="canonical" href="./.././k">'),
    (30, "http://j.example.com/k", '<link rel="canonical" href="http://example.com/de/y">'),
    (31, "http://l.org/x", '<link rel="canonical" href="http://bad.net/s?a=1&b=2">'),
]
VERDICTS = {
    1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: ("example.net/en/", "allow"), 5: ("org/fr/", "allow"),
    6: (None, "allow"), 7: ("example.com/de/", "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
    11: (None, "allow"), 12: ("net/", "block"), 13: (None, "block"), 14: (None, "block"), 15: (None, "block"), 16: (None, "block"),
    17: (None, "block"), 18: (None, "block"), 19: (None, "block"), 20: (None, "block"), 21: (None, "block"), 22: (None, "block"),
    23: (None, "block"), 24: (None, "block"), 25: (None, "block"), 26: (None, "allow"), 27: (None, "allow"), 28: (None, "block"),
    29: (None, "block"), 30: (None, "block"), 31: (None, "block"),
}


def test_url_filters(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://c.example.com/to", "http://b.example.com/"), (None, "http://bad.net/p")], "from_url string, to_url string")
    found = urls.judged(pages, redirects=redirects).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == VERDICTS
    assert {r.page_id: (r.host, r.path) for r in found if r.page_id in (2, 9, 10, 14)} == {
        2: ("a.example.com", "/y"), 9: ("", ""), 10: ("", ""), 14: ("x.example.net", ""),
    }
    assert urls.judged(pages.limit(0)).count() == 0
    clashing = pages.selectExpr("page_id", "url", "html", "1 AS node", "2 AS _node", "3 AS _aliased", "4 AS bad", "5 AS action", "6 AS rule", "7 AS row")
    out = urls.judged(clashing, redirects=redirects)
    assert out.columns == ["page_id", "url", "node", "_node", "_aliased", "bad", "action", "row", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.rule, r.verdict) for r in out.filter("bad = 4 AND action = 5").collect()} == VERDICTS


def test_url_filters_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op9_url_filters"]).fetchall()
    found = [tuple(r) for r in queries.url_filter(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_pipeline_keeps_clean_documents_and_packs_all(spark, tmp_path):
    rng = random.Random(6)
    words = ["river", "stone", "light", "under", "carry", "seven", "often", "paper", "glass", "north", "quiet", "market"]
    clean = [" ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(120)) for _ in range(60)]
    texts = [*clean, clean[0], "too short", "### $$$ *** " * 40, "same words here " * 60, None, ""]
    data = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids == set(range(61)) if k < 2 else ids == set(range(60)), name
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == corpus_pipeline.COLUMNS
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert packed.filter("piece = 0").count() == mixed.count()
