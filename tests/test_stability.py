"""The stability job against brute force over single draws, conservation of thinned counts, and exact draw sizes."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corrobora.operators import stability as st
from corrobora.plans.resampling import worst_agreement

DONORS, FEW, ALL = ["d1", "d2"], ("A", "B"), ("A", "B", "C")
SCENARIOS = [
    st.Scenario("n5", st.CELL_N, 5, FEW),
    st.Scenario("n3_all", st.CELL_N, 3, ALL),
    st.Scenario("half", st.CELL_FRACTION, 0.5, FEW),
    st.Scenario("all_cells", st.CELL_FRACTION, 1.0, FEW),
    st.Scenario("too_many", st.CELL_N, 1000, FEW),
    st.Scenario("depth", st.UMI_FRACTION, 0.3, FEW),
    st.Scenario("depth_all", st.UMI_FRACTION, 1.0, FEW),
]
REPS, SEED, GENES = 37, 9, 12


def data():
    rng = np.random.default_rng(4)
    cells, counts = [], []
    for i in range(400):
        donor, kind = DONORS[i % 2], ["A", "A", "B", "C", "other"][i % 5]
        own = {int(g): int(n) for g, n in zip(rng.choice(GENES, 4, replace=False), rng.integers(1, 9, 4))}
        beyond = int(rng.integers(0, 5))
        cells.append((i, donor, kind, sum(own.values()) + beyond))
        counts += [(i, g, n) for g, n in own.items()]
    return cells, counts


def mixed(x: int) -> int:
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) % 2**64
    return x ^ x >> 31


def word(*labels) -> int:
    return int(hashlib.md5("|".join(map(str, labels)).encode()).hexdigest()[:16], 16)


def quantile(n: int, p: float, u: float) -> int:
    from math import comb

    if p == 1:
        return n
    k, c = 0, (1 - p) ** n
    while c <= u and k < n:
        k += 1
        c += comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def brute(cells, counts, scenario):
    """Winner of every draw and gene, as a type, 'tie' or 'zero'."""
    by_cell = defaultdict(list)
    for c, g, n in counts:
        by_cell[c].append((g, n))
    out = []
    for rep in range(REPS):
        w = word(SEED, scenario.name, rep)
        scores = defaultdict(lambda: defaultdict(float))
        for d in DONORS:
            for t in scenario.types:
                own = [c for c in cells if c[1] == d and c[2] == t]
                sums, total = Counter(), 0
                if scenario.operation == st.UMI_FRACTION:
                    whole = Counter()
                    for c in own:
                        for g, n in by_cell[c[0]]:
                            whole[g] += n
                    draw = lambda label, n: quantile(n, scenario.parameter, (mixed(word(SEED, d, t, label) ^ w) >> 12) / 2**52)
                    for g, n in whole.items():
                        sums[g] = draw(g, n)
                    total = sums.total() + draw("other", sum(c[3] for c in own) - whole.total())
                else:
                    k = int(scenario.parameter) if scenario.operation == st.CELL_N else max(1, int(len(own) * scenario.parameter))
                    for c in sorted(own, key=lambda c: mixed(word(SEED, d, t, c[0]) ^ w))[:k]:
                        total += c[3]
                        for g, n in by_cell[c[0]]:
                            sums[g] += n
                for g, n in sums.items():
                    scores[g][t] += np.log1p(1e6 * n / total) / len(DONORS)
        for g in range(GENES):
            own = scores[g]
            best = max(own.values(), default=0)
            near = [t for t, s in own.items() if best - s <= 1e-10]
            out.append((g, "zero" if best <= 0 else "tie" if len(near) > 1 else near[0]))
    return Counter(out)


@pytest.fixture(scope="module")
def frames(spark):
    cells, counts = data()
    a = spark.createDataFrame(cells, "cell_id long, donor string, cell_type string, total long").repartition(3)
    b = spark.createDataFrame(counts, "cell_id long, gene_id long, umi long").repartition(5)
    return cells, counts, a, b, spark.range(GENES + 1).withColumnRenamed("id", "gene_id")


@pytest.mark.parametrize("combined", [64, 2])
def test_tallies_equal_single_draws(spark, frames, monkeypatch, combined):
    monkeypatch.setattr(st, "COMBINED_ROWS", combined)
    monkeypatch.setattr(st, "GENES_AT_ONCE", 5)
    cells, counts, a, b, genes = frames
    table = st.design(a, SCENARIOS, DONORS)
    found = {(r["gene_id"], r["scenario"]): r for r in st.tallies(a, b, genes, table, SCENARIOS, DONORS, REPS, SEED).collect()}
    assert {s for _, s in found} == {s.name for s in SCENARIOS} - {"too_many"}
    assert len(found) == (GENES + 1) * (len(SCENARIOS) - 1)
    for s in SCENARIOS:
        if s.name == "too_many":
            continue
        want = brute(cells, counts, s)
        for g in range(GENES):
            r = found[g, s.name]
            assert r["wins"] == [want[g, t] for t in s.types], (g, s.name)
            assert (r["zero"], r["tie"]) == (want[g, "zero"], want[g, "tie"])
        assert found[GENES, s.name]["zero"] == REPS


def test_every_draw_has_its_size_whatever_the_window(spark, frames, monkeypatch):
    _, _, a, _, _ = frames
    plan = st.Plan(st.design(a, SCENARIOS, DONORS), SCENARIOS, DONORS, REPS, SEED)
    bits = {}
    for width in (6.0, 0.01):
        monkeypatch.setattr(st, "WIDTH", width)
        bits[width] = {r["cell_id"]: bytes(r["bits"]) for r in st.cell_bits(a.repartition(1 if width > 1 else 9), plan).collect()}
    assert bits[6.0] == bits[0.01]
    drawn = st.drawn_cells(st.cell_bits(a, plan), plan).groupBy("scenario", "donor", "cell_type").agg(F.sum("n_draws").alias("n")).collect()
    sizes = {(r["scenario"], r["donor"], r["cell_type"]): r["n"] for r in drawn}
    for r in st.design(a, SCENARIOS, DONORS).filter("operation <> 'umi_fraction' AND feasible").collect():
        assert sizes[r["scenario"], r["donor"], r["cell_type"]] == REPS * r["selected_cells"]
    assert set(st.thinned(np.array([5, 0]), np.array([1, 2], np.uint64), plan, st.Binomials())[:, 1].ravel().tolist()) == {5, 0}


def test_missing_groups_make_a_scenario_infeasible(spark, frames):
    _, _, a, _, _ = frames
    table = st.design(a.filter("NOT (donor = 'd2' AND cell_type = 'C')"), SCENARIOS, DONORS)
    short = {r["scenario"] for r in table.filter("NOT feasible").collect()}
    assert short == {"too_many", "n3_all"}
    gone = table.filter("scenario = 'n3_all' AND donor = 'd2' AND cell_type = 'C'").first()
    assert (gone["available_cells"], gone["selected_cells"]) == (0, 3)


def test_scored_counts_above_the_library_are_refused(spark, frames):
    _, _, a, b, genes = frames
    plan = st.Plan(st.design(a, SCENARIOS, DONORS), SCENARIOS, DONORS, REPS, SEED)
    sums = spark.createDataFrame([(1, "d1", "A", 10)], "gene_id long, donor string, cell_type string, umi long")
    totals = spark.createDataFrame([("d1", "A", 9)], "donor string, cell_type string, total long")
    with pytest.raises(Exception, match="exceed the library"):
        st.thinned_totals(sums, totals, plan)


def test_binomials_of_large_counts():
    b = st.Binomials()
    u = np.linspace(0.0001, 0.9999, 101)[None, :]
    for n, p in ((10**6, 0.25), (10**12, 0.5), (3, 0.75)):
        got = b.draw(np.array([n]), p, u)[0]
        z = (got - n * p) / np.sqrt(n * p * (1 - p))
        assert (np.diff(got) >= 0).all() and abs(np.median(z)) < 0.8 and abs(z).max() < 4.5 and 0 <= got.min() <= got.max() <= n


def test_looked_up_quantiles_are_the_searched_ones():
    """Also on the steps themselves and next to the ends of the parts."""
    b = st.Binomials()
    for n, p in ((1, 0.25), (3, 0.5), (119, 0.75), (5000, 0.25)):
        first, cdf = b.cdf(n, p)
        ends = np.arange(st.GUIDE) / st.GUIDE
        u = np.concatenate([np.random.default_rng(n).random(3000), ends, np.nextafter(ends[1:], 0), cdf[cdf < 1], np.nextafter(cdf[cdf < 1], 0)])
        counts = np.array([0, n, n])
        got = b.draw(counts, p, np.stack([u, u, u[::-1]]))
        want = np.minimum(n, first + np.searchsorted(cdf, u, "right"))
        assert (got[0] == 0).all() and (got[1] == want).all() and (got[2] == want[::-1]).all()
        assert (b.guide(n, p) >= 0).mean() > 0.5


def test_least_agreement_is_that_of_all_tallies_and_scores_fewer_draws(spark, frames, monkeypatch):
    monkeypatch.setattr(st, "SCORED_AT_ONCE", 8)
    _, _, a, b, genes = frames
    table = st.design(a, SCENARIOS, DONORS)
    names = {types: ";".join(types) for types in (FEW, ALL)}
    tops = [(g, names[FEW], "AB"[g % 2]) for g in range(GENES - 1)] + [(g, names[ALL], "CAB"[g % 3] if g != 4 else None) for g in range(GENES + 1)]
    baselines = spark.createDataFrame(tops, "gene_id long, comparison_types string, baseline_top_type string")
    told = st.stability(st.tallies(a, b, genes, table, SCENARIOS, DONORS, REPS, SEED), baselines, SCENARIOS, ALL, REPS)
    want = {r["gene_id"]: tuple(r)[1:] for r in worst_agreement(told, "n3_all").collect()}
    found = st.least_agreement(a, b, genes, baselines, table, SCENARIOS, DONORS, REPS, SEED, "n3_all")
    assert {r["gene_id"]: tuple(r)[1:] for r in found.collect()} == want
    assert want[GENES - 1][0] is None and want[4][1] is None and want[GENES][1] == 0.0 and 0 < want[1][0] < 1
    none = st.design(a.limit(0), SCENARIOS[:1], DONORS)
    assert st.least_agreement(a, b, genes, baselines, none, SCENARIOS[:1], DONORS, REPS, SEED, "n3_all").count() == 0

    plan = st.Plan(table, SCENARIOS[:6], DONORS, REPS, SEED)
    scored = []

    class Told:
        genes = np.array([7, 8], object)

        def winners(self, s, some, lo, hi):
            scored.append((s, some.tolist(), hi - lo))
            first = [*plan.sampled, *plan.thinned][s].name == "n5"
            return np.array([[-1 if first and (g == 0 or lo + i > 8) else 0 for i in range(hi - lo)] for g in some])

    markers = pa.table({"gene_id": [7, 8], "tops": pa.array([[(names[FEW], "A")]] * 2, pa.map_(pa.string(), pa.string()))})
    got = st._least(plan, "n3_all")(Told(), markers).to_pylist()
    assert got == [{"gene_id": 7, "least": 0, "held": None}, {"gene_id": 8, "least": 9, "held": None}]
    assert sum(n for _, _, n in scored) == REPS + 3 * 2 * 8
    assert all(some == [1] for _, some, _ in scored[1:])


def test_products_rank_as_means_of_logarithms(monkeypatch):
    rng = np.random.default_rng(6)
    cpm = rng.integers(0, 3, (40, 5, 4, 30)) * rng.choice([0.5, 3.25, 1e5], (5, 4, 1))
    cpm[3] = 0
    cpm[4, :, 1] = cpm[4, :, 2] = 9
    by_products = st._winners(cpm.copy())
    monkeypatch.setattr(st, "MOST_FACTORS", 4)
    assert (st._winners(cpm.copy()) == by_products).all()
    assert (by_products[3] == -1).all() and {-2, -1, 0, 1, 2, 3} == set(by_products.ravel().tolist())
    assert st._winners(np.full((1, 300, 2, 1), 1e6) * [[[1], [0.5]]]).tolist() == [[0]]


def test_only_draws_that_hold_a_gene_are_scored(spark, frames, monkeypatch):
    _, _, a, _, _ = frames
    plan = st.Plan(st.design(a, SCENARIOS, DONORS), SCENARIOS, DONORS, REPS, SEED)
    draws = np.zeros((2, len(plan.sampled), REPS), np.uint8)
    draws[0, 0, [5, 30]] = draws[1, 0, 30] = 1
    bits = [np.packbits(x, axis=1).tobytes() for x in draws]
    batch = pa.table({
        "gene_id": [1, 1], "group": pa.array([0, 1], pa.int32()), "umi": [4, 9], "bits": pa.array(bits, pa.binary()),
        "sums": pa.nulls(2, pa.binary()), "marker": [False, False],
    })
    library = np.ones((len(plan.groups), len(plan.sampled) + len(plan.thinned), REPS))
    counts = st._Counts(plan, library, [1], np.zeros(2, int), batch, st.Binomials())
    scored, winners = [], st._winners
    monkeypatch.setattr(st, "_winners", lambda cpm: scored.append(cpm.shape[-1]) or winners(cpm))
    want = np.full((1, REPS), -1)
    want[0, [5, 30]] = 0, 1
    assert (counts.winners(0, np.array([0]), 0, REPS) == want).all() and scored == [2]
    monkeypatch.setattr(st, "SPARSE", 10**9)
    assert (counts.winners(0, np.array([0]), 0, REPS) == want).all() and scored == [2, REPS]


def test_keyed_draws_are_those_of_their_numbers():
    b, rng = st.Binomials(), np.random.default_rng(3)
    n = np.array([0, 1, 7, 7, 300, 300_000, 2**33])
    base, labels = rng.integers(0, 2**63, len(n)).astype(np.uint64), rng.integers(0, 2**63, 2000).astype(np.uint64)
    u = (st.mixed(base[:, None] ^ labels[None, :]) >> np.uint64(12)) * 2.0**-52
    for p in (0.25, 0.75, 1.0):
        got = b.draw_keyed(n, p, base, labels, st._Hashes())
        assert (got == b.draw(n, p, u)).all() and (got <= n[:, None]).all()
        for value, row, x in zip(n[1:], got[1:], u[1:]):
            first, cdf = b.cdf(int(value), p) if p < 1 else (int(value), np.ones(1))
            assert (row == np.minimum(value, first + (np.searchsorted(cdf, x, "right") if p < 1 else 0))).all()
