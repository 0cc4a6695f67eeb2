"""All pairs: rows of whole sources, made without a join of pairs."""

import math

import numpy as np
import pytest
from model import paths
from pyspark.sql import functions as F

import hopscale as H
from hopscale.operators.sssp import ShortestPaths, explore, explore_many
from hopscale.plans.queries import QUERIES
from test_whole_queries import against_sql

D = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_network(spark):
    """Ties, a cost of 0, long edges, two parts, a node without edges."""
    edges = [(0, 1, 2.0), (1, 2, 0.0), (2, 3, 2.5), (0, 3, 4.5), (3, 4, 90.0), (0, 4, 95.0), (4, 5, 0.5), (10, 11, 1.0)]
    nodes = [*range(6), 10, 11, 20]
    return H.Network(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.createDataFrame([(n,) for n in nodes], "node_id long")), nodes, edges


@pytest.mark.parametrize("cutoff", [None, 4.0])
@pytest.mark.parametrize("most", [100, 2])
def test_every_pair_with_and_without_a_path(spark, cutoff, most):
    network, nodes, edges = odd_network(spark)
    d = paths(nodes, edges)
    zones = [*nodes[::2], 99]  # 99 is no node
    z = spark.createDataFrame([(x,) for x in zones], "zone long")
    got = {(r.src, r.dst): r.cost for r in ShortestPaths(network).matrix(z, cutoff, most).collect()}
    reach = math.inf if cutoff is None else cutoff
    want = {(s, t): c if (c := d.get(s, {}).get(t, math.inf)) <= reach else math.inf for s in zones for t in zones}
    assert got == want


def test_dense_costs_join_and_shuffle_no_pairs(spark):
    made = plan(QUERIES["dense_cost"](spark, D))
    assert not any(x in made for x in ("NestedLoopJoin", "CartesianProduct", "LeftOuter"))
    network, *_ = odd_network(spark)
    # beyond the bound the pairs are joined, but what the searches find is never broadcast
    z = spark.range(9).select(F.col("id").alias("zone"))
    made = plan(ShortestPaths(network).matrix(z, None, 2))
    assert "SortMergeJoin" in made and "BroadcastHashJoin" not in made


@pytest.mark.parametrize("low", [0.0, 1.0, 50.0])
def test_waves_find_what_single_searches_find(low):
    rng = np.random.default_rng(3)
    n, m = 200, 500
    src, dst = rng.integers(0, n, (2, m))
    cost = low + rng.exponential(10, m) * (rng.random(m) > 0.2)
    s, t, c = np.concatenate((src, dst)), np.concatenate((dst, src)), np.concatenate((cost, cost))
    order = np.argsort(s, kind="stable")
    starts, ends, costs = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n)))), t[order], c[order]
    sources = np.array([7, 0, 199, 7])
    for step in (0.0, costs.min(), costs.mean() / 2, 1e9):
        rows = explore_many(starts, ends, costs, sources, step)
        for at, row in zip(sources.tolist(), rows, strict=True):
            one = explore(starts.tolist(), ends.tolist(), costs.tolist(), at, math.inf)
            assert {k: x for k, x in enumerate(row.tolist()) if x < math.inf} == one


@pytest.mark.parametrize("name", ["dense_accessibility", "approx_error"])
def test_dense_product_joins_the_activity_only(spark, name):
    """The matrix is neither broadcast nor shuffled: beside it stands the broadcast activity, and sums are begun before the exchange."""
    lines = plan(QUERIES[name](spark, D)).split("\n")
    made = [x for x in lines if "Exchange" in x or "MapInArrow" in x or "HashAggregate" in x or "LeftOuter" in x]
    assert not any(x in "".join(lines) for x in ("NestedLoopJoin", "CartesianProduct"))
    at = next(i for i, x in enumerate(made) if "MapInArrow" in x)
    assert "BroadcastHashJoin" in made[at - 1] and "partial_sum" in made[at - 2]
    assert against_sql(spark, name)


@pytest.mark.parametrize("zones", [None, [0, 2, 4, 5, 11, 20]])
def test_costs_of_every_pair_of_zones(spark, zones):
    """As those of get_costs, also beyond the bound; pairs without a path have no layer."""
    network, *_ = odd_network(spark)
    h = H.Hierarchy(network, base_radius=2.0, zones=zones)
    z = h.zones.select(F.col("zone").alias("src"))
    want = sorted(map(tuple, h.get_costs(z.crossJoin(z.withColumnRenamed("src", "dst"))).collect()), key=lambda r: r[:2])
    assert len({r[3] for r in want}) > 1 and any(r[3] is None and r[2] == math.inf for r in want)
    for most in (100, 2):
        assert sorted(map(tuple, h.get_all_costs(most).collect()), key=lambda r: r[:2]) == want


def test_zones_whose_layers_store_nothing_have_rows(spark):
    """Stored tables may lack a zone's costs: its row is there, without costs."""
    network, *_ = odd_network(spark)
    h = H.Hierarchy(network, base_radius=2.0)
    h.costs = h.costs.where("src not in (4, 20) and dst <> 4")
    z = h.zones.select(F.col("zone").alias("src"))
    want = h.get_costs(z.crossJoin(z.withColumnRenamed("src", "dst")))
    got = h.get_all_costs()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("src = 20").count() == 9


def test_query_of_every_pair_joins_no_pairs(spark):
    made = plan(QUERIES["get_cost_pairs"](spark, D))
    assert "NestedLoopJoin" not in made and "CartesianProduct" not in made
