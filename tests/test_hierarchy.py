"""Golden tables, and random graphs against the plain model."""

import math
import random

import numpy as np
import pytest
from model import Model
from pyspark.sql import functions as F

import hopscale as H
from hopscale.operators.ranking import ranked
from hopscale.operators.representatives import first_independent_set, prefixes
from hopscale.operators.sssp import ShortestPaths, pick_strategy
from hopscale.scratch import Scratch


def make(spark, edges, **options):
    return H.Hierarchy(H.Network(spark.createDataFrame(edges, "src long, dst long, cost double")), **options)


def costs_of(h):
    out = [{} for _ in h.radii]
    for r in h.costs.collect():
        assert (r.src, r.dst) not in out[r.layer]
        out[r.layer][r.src, r.dst] = r.cost
    return out


def groups_of(h):
    out = [{} for _ in h.radii]
    for r in h.groups.collect():
        out[r.layer][r.zone] = r.rep
    return out


def random_graph(seed, n, extra):
    r = random.Random(seed)
    edges = {(r.randrange(k), k): float(r.randint(1, 20)) for k in range(1, n)}
    for _ in range(extra):
        a, b = sorted(r.sample(range(n), 2))
        edges.setdefault((a, b), float(r.randint(1, 20)))
    return [(a, b, c) for (a, b), c in edges.items()]


def test_toy(spark):
    h = make(spark, [(0, 1, 10.0), (1, 2, 15.0), (2, 3, 20.0)], base_radius=10)
    assert h.radii == [10, 20, 40] and h.cutoffs == [15, 30, None]
    assert [i["n_representatives"] for i in h.get_layer_info()] == [4, 4, 3]
    assert [i["n_costs"] for i in h.get_layer_info()] == [8, 12, 9]
    assert groups_of(h)[2] == {0: 0, 1: 0, 2: 2, 3: 3}
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    got = {(r.src, r.dst): r.cost for r in h.get_costs(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == dict(zip(pairs, [10, 25, 45, 15, 45, 20], strict=True))
    assert h.verify_group_nesting() == (True, [])
    ih = H.InteractionHierarchy(h, lambda c: (c + 5) ** -1)
    assert np.allclose(ih @ [5, 10, 8, 3], [1.9933333, 2.7933333, 2.3866667, 1.22], atol=1e-7)
    assert np.allclose(ih @ np.eye(4), np.column_stack([ih.matvec(c) for c in np.eye(4)]), atol=1e-12)
    assert np.allclose(ih.get_row(1), (ih @ np.eye(4))[1], atol=1e-12)
    assert [i["n_corrections"] for i in ih.get_layer_info()] == [8, 12, 0]
    alone = H.InteractionHierarchy(h, "1 / (cost + 5)", self_interaction=False)
    assert alone.interactions.where("layer = 0 and src = dst").count() == 0
    assert np.allclose(alone.matvec([5, 10, 8, 3]), ih.rmatvec([5, 10, 8, 3]), atol=1e-12)


@pytest.mark.parametrize(("n", "base", "reps", "costs"), [(5, 2000, [25, 13, 5], [365, 165, 25]), (10, 2500, [100, 20, 6], [1960, 246, 36])])
def test_grids(spark, n, base, reps, costs):
    h = H.Hierarchy(H.generate_grid_network(spark, n, n), base_radius=base)
    assert [i["n_representatives"] for i in h.get_layer_info()] == reps
    assert [i["n_costs"] for i in h.get_layer_info()] == costs
    assert h.get_cost(0, n * n - 1) == {5: 8000, 10: 13000}[n]
    assert h.get_density() == sum(costs) / n**4 and h.get_finest_layer_density() == costs[0] / n**4
    assert h.total_nodes_explored >= sum(costs)


@pytest.mark.parametrize("seed", range(4))
def test_against_model(spark, seed):
    edges = random_graph(seed, 24, 14)
    zones = None if seed % 2 else sorted(random.Random(seed).sample(range(24), 15))
    overlap = [0.6, 1.5, 2.0, 1.0][seed]
    m = Model(range(24), edges, 6, 2, overlap, zones)
    h = make(spark, edges, base_radius=6, overlap_factor=overlap, zones=zones, backend="dataframe" if seed == 2 else "auto")
    assert h.radii == m.radii and costs_of(h) == m.costs and groups_of(h) == m.groups
    f = lambda c: (c + 3.0) ** -1.5
    a = np.random.RandomState(seed).rand(len(m.zones))
    want = [sum(f(m.cost(i, j)) * a[k] for k, j in enumerate(m.zones) if m.cost(i, j) < math.inf) for i in m.zones]
    # a function of plain numbers runs on Arrow batches
    g = f if seed else (lambda c: math.pow(c + 3.0, -1.5))
    assert np.allclose(H.InteractionHierarchy(h, g).matvec(a), want, atol=1e-12)


def test_disconnected_and_chain(spark):
    chain = [(k, k + 1, 100.0) for k in range(14)] + [(20, 21, 50.0)]
    h = make(spark, chain, base_radius=300, overlap_factor=1.0)
    assert h.get_cost(0, 20) == math.inf
    m = Model([*range(15), 20, 21], chain, 300, 2, 1.0)
    assert costs_of(h) == m.costs
    ih = H.InteractionHierarchy(h, H.power_law_interaction)
    assert ih.matvec(np.ones(17)).min() > 0
    assert h.costs.where("src <> dst and cost = 0").count() == 0


def test_routing_through_other_nodes(spark):
    h = make(spark, [(0, 1, 10.0), (1, 2, 10.0), (2, 3, 10.0)], base_radius=50, overlap_factor=2, zones=[0, 3])
    assert h.n_zones == 2 and h.get_cost(0, 3) == 30


def test_zero_decay(spark):
    edges = [(k, k + 1, 100.0) for k in range(9)]
    h = make(spark, edges, base_radius=200)
    step = lambda c: F.when(c <= 300, 1.0).otherwise(0.0)
    m = Model(range(10), edges, 200)
    want = [sum(m.cost(i, j) <= 300 for j in range(10)) for i in range(10)]
    assert H.InteractionHierarchy(h, step, exact_zero=True).matvec(np.ones(10)).tolist() == want


def test_searches_agree(spark):
    edges = random_graph(7, 40, 30)
    n = H.Network(spark.createDataFrame(edges, "src long, dst long, cost double"))
    src = spark.range(0, 40, 7).select(F.col("id").alias("src"))
    rows = [sorted(map(tuple, ShortestPaths(n, s, p).search(src, c).collect())) for s, p, c in (("broadcast", 1, 25.0), ("broadcast", 8, 25.0), ("dataframe", None, 25.0))]
    assert rows[0] == rows[1] == rows[2]
    full = compare = sorted(map(tuple, ShortestPaths(n, "dataframe").search(src).collect()))
    assert full == compare == sorted(map(tuple, ShortestPaths(n, "broadcast").search(src).collect()))


def test_ranks(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 5003).alias("zone")).repartition(5)
    tmp = Scratch(spark)
    one, many = (sorted(map(tuple, ranked(tmp, df, ["zone"], f"r{k}", small).collect())) for k, small in enumerate((1000, 10)))
    assert one == many and [r for _, r in one] == list(range(500))


def test_independent_set_rounds(spark):
    r = random.Random(3)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)}
    near = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")
    zones = spark.range(60).select(F.col("id").alias("zone"))
    tmp = Scratch(spark)
    (a, m), (b, n) = first_independent_set(tmp, zones, near, "a"), first_independent_set(tmp, zones, near, "b", max_driver_pairs=5)
    one, many = (sorted(x.zone for x in t.collect()) for t in (a, b))
    assert one == many and m == n == 60 - len(one)


def test_prefixes_do_not_follow_the_ids(spark):
    """On a 100 x 100 lattice whose ids ascend by rows, rounds would follow chains of ids; scans are as many as the pairs need."""
    n, near = 100, [(i * 100 + j, (i + a) * 100 + j + b) for i in range(100) for j in range(100) for a, b in ((0, 1), (0, 2), (1, 0), (2, 0), (1, 1), (1, -1)) if i + a < 100 and 0 <= j + b < 100]
    df = spark.createDataFrame([(max(p), min(p)) for p in near], "src long, dst long")
    smaller = {}
    for p in near:
        smaller.setdefault(max(p), []).append(min(p))
    want = []
    chosen = set()
    for z in range(n * n):
        if chosen.isdisjoint(smaller.get(z, ())):
            chosen.add(z)
            want.append(z)
    reps, _, scans = prefixes(Scratch(spark), spark.range(n * n).select(F.col("id").alias("zone")), df, "grid", 10_000)
    assert sorted(r.zone for r in reps.collect()) == want and scans <= 2 * len(near) / 10_000 + 1


def test_searches_that_settle(spark):
    """Long paths: entries far behind the front are settled and still found."""
    edges = [(k, k + 1, float(1 + k % 3)) for k in range(40)] + [(0, 40, 90.0), (5, 30, 4.0)]
    n = H.Network(spark.createDataFrame(edges, "src long, dst long, cost double"))
    src = spark.createDataFrame([(0,), (17,)], "src long")
    assert sorted(map(tuple, ShortestPaths(n, "dataframe").search(src).collect())) == sorted(map(tuple, ShortestPaths(n, "broadcast").search(src).collect()))


def test_broadcast_is_bounded():
    assert pick_strategy("auto", 3_000_000) == "dataframe" and pick_strategy("broadcast", 100) == "broadcast"
    with pytest.raises(ValueError, match="broadcast"):
        pick_strategy("broadcast", 3_000_000)


def test_a_group_that_does_not_nest(spark):
    h = make(spark, [(0, 1, 10.0), (1, 2, 15.0), (2, 3, 20.0)], base_radius=10)
    # zones 0 and 1 share a group on layer 1, and not on layer 2
    rows = [(0, z, z) for z in range(4)] + [(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 0, 0), (2, 1, 2), (2, 2, 2), (2, 3, 3)]
    h.groups = spark.createDataFrame(rows, "layer int, zone long, rep long")
    assert [tuple(r) for r in h.nesting_violations().collect()] == [(1, 0, 2, 2)]
    ok, words = h.verify_group_nesting()
    assert not ok and len(words) == 1 and "group 0" in words[0]


@pytest.mark.parametrize(("overlap", "low", "high"), [(1.5, 0.0545, 0.055), (3.0, 0.0056, 0.0058)])
def test_accuracy(spark, overlap, low, high):
    h = H.Hierarchy(H.generate_grid_network(spark, 10, 10), base_radius=3000, overlap_factor=overlap)
    f = lambda c: F.pow(c + 2000.0, F.lit(-1.5))
    dense = H.compute_dense_interaction_matrix(H.compute_dense_cost_matrix(h.network), f)
    full = np.zeros((100, 100))
    for r in dense.collect():
        full[r.src, r.dst] = r.value
    rng = np.random.RandomState(42)
    a = np.column_stack([rng.rand(100) * 100 + 1 for _ in range(5)])
    errors = np.abs(H.InteractionHierarchy(h, f) @ a - full @ a) / (full @ a)
    assert low < np.median(errors.mean(0)) < high
