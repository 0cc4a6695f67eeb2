"""Queries over all sources, pairs and layers, against their SQL."""

import pytest

from hopscale.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.01"


def against_sql(spark, name):
    """The query's rows, which are those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("supplier", "lineitem"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    want = c.execute(ORACLES[name]).fetchall()
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    got = df.collect()
    key = lambda r: tuple((x is not None, round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(key([r[n] for n in names]) for r in got) == sorted(map(key, want))
    return got


def zones(spark):
    return {r[0] for r in spark.read.parquet(f"{D}/supplier.parquet").select("s_suppkey").collect()}


def test_rounds_from_every_node(spark):
    assert {r.src for r in against_sql(spark, "sssp_rounds")} == zones(spark)


def test_costs_of_all_pairs(spark):
    z = zones(spark)
    assert {(r.src, r.dst) for r in against_sql(spark, "get_cost_pairs")} == {(a, b) for a in z for b in z}


def test_all_layers_of_a_subset(spark):
    assert len({r.layer for r in against_sql(spark, "zone_subset_costs")}) > 1


@pytest.mark.parametrize("name", ["edge_problems", "components_cut", "nodes_explored", "without_self", "accessibility_transposed", "decay_power", "stored_network", "stored_coordinates", "stored_single_file"])
def test_against_sql(spark, name):
    assert against_sql(spark, name)


def test_broken_groups_are_told(spark):
    assert len(against_sql(spark, "nesting_broken")) > 3
