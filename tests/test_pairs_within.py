"""The range join, against all pairs."""

import math

import pytest
from test_all_pairs import plan

from hopscale.plans.queries import ORACLES, QUERIES
from hopscale.sources.generators import between, pairs_within


def table(spark, points):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "node_id long, x double, y double")


def pairs(points, radius):
    """By the sum of squares, as in the SQL."""
    near = lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) <= radius * radius
    return {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if i < j and near(a, b)}


def test_pairs_at_the_radius(spark):
    """A sum of squares just above the square has a root that rounds to the radius; it is no pair."""
    points = [(0.1 * i, 0.1 * j) for i in range(12) for j in range(12)]
    want = pairs(points, 0.5)
    assert want != {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if i < j and math.dist(a, b) <= 0.5}
    got = [(r.src, r.dst) for r in pairs_within(table(spark, points), 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_difference_that_rounds_to_the_radius(spark):
    """Its ends lie two cells of that width apart."""
    points = [(-1e-20, 0.0), (150.0, 0.0)]
    assert pairs(points, 150.0) == {(0, 1)}
    assert [(r.src, r.dst, r.cost) for r in pairs_within(table(spark, points), 150.0).collect()] == [(0, 1, 150.0)]


def test_crowded_cells_lose_and_double_nothing(spark):
    points = [((k * 7) % 40 / 10, (k * 13) % 50 / 10) for k in range(150)] + [(30.0 + k, 2.0) for k in range(9)]
    t = table(spark, points)
    for cell_points in (4096, 20, 1):
        got = [(r.src, r.dst) for r in pairs_within(t, 2.5, cell_points).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs(points, 2.5)
        some = t.where("node_id % 3 = 0")
        got = [(r.src, r.dst) for r in between(some, t, 2.5, cell_points).collect()]
        want = pairs(points, 2.5)
        assert sorted(got) == sorted((i, j) for i in range(0, len(points), 3) for j in range(len(points)) if i == j or (min(i, j), max(i, j)) in want)


def test_points_are_dealt_and_not_broadcast(spark):
    """A file of points is small and may be one task's, its pairs are many."""
    made = plan(QUERIES["range_join_edges"](spark, "/root/testdata/sf0.01"))
    assert "SortMergeJoin" in made and "Broadcast" not in made


def test_range_join_edges_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("create view customer as select * from '/root/testdata/sf0.1/customer.parquet'")
    want = c.execute(ORACLES["range_join_edges"]).fetchall()
    got = [tuple(r) for r in QUERIES["range_join_edges"](spark, "/root/testdata/sf0.1").collect()]
    assert sorted(got) == sorted(want)
