"""Storage round trips, generators, decay functions, streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import hopscale as H
from hopscale.sources.generators import delaunay_edges, pairs_within
from hopscale.sources.storage import export_npz, import_npz
from hopscale.streaming.activity import RunningAccessibility, windowed_activity


@pytest.fixture(scope="module")
def ih(spark):
    return H.InteractionHierarchy(H.Hierarchy(H.generate_grid_network(spark, 5, 5), base_radius=2000), "1 / (cost + 2000)")


def test_round_trip(spark, ih, tmp_path):
    a = np.arange(25.0)
    path = ih.save(str(tmp_path / "ih"), include_network=True, interaction_fn_hint="inverse")
    back = H.InteractionHierarchy.load(spark, path)
    assert np.allclose(back.matvec(a), ih.matvec(a), rtol=1e-12)
    assert back.hierarchy.get_cost(0, 24) == 8000 and back.hierarchy.network.n_edges == 40
    assert back.hierarchy.total_nodes_explored == 0 and back.hierarchy.n_workers == 1
    assert back.hierarchy.get_layer_info() == ih.hierarchy.get_layer_info()
    plain = H.Hierarchy.load(spark, ih.hierarchy.save(str(tmp_path / "h")))
    assert plain.network is None and plain.verify_group_nesting()[0]
    assert np.allclose(H.InteractionHierarchy(plain, lambda c: (c + 2000) ** -1).matvec(a), ih.matvec(a))
    again = import_npz(spark, export_npz(ih.hierarchy, str(tmp_path / "x"), include_network=True))
    assert again.network.n_edges == 40 and again.reps.exceptAll(ih.hierarchy.reps).count() == 0
    assert again.get_layer_info() == ih.hierarchy.get_layer_info() and again.cutoffs[-1] is None
    with pytest.raises(H.StorageError, match="not an InteractionHierarchy"):
        H.load_interaction(spark, str(tmp_path / "h"))


def test_single_file(spark, ih, tmp_path):
    a = np.arange(25.0)
    path = ih.save(str(tmp_path / "one"), backend="npz", include_network=True, interaction_fn_hint="inverse")
    assert path.endswith(".npz")
    # found by content, whatever the name
    (tmp_path / "one.npz").rename(tmp_path / "renamed.bin")
    back = H.load_interaction(spark, str(tmp_path / "renamed.bin"))
    assert np.allclose(back.matvec(a), ih.matvec(a), rtol=1e-12) and back.hierarchy.network.n_edges == 40
    key = lambda x: {(r.layer, r.src, r.dst): (r.value, r.correction, r.net) for r in x.interactions.collect()}
    assert all(np.allclose([v or 0 for v in key(back)[k]], [v or 0 for v in key(ih)[k]], rtol=1e-14) for k in key(ih)) and len(key(back)) == len(key(ih))
    assert {k for k, v in key(back).items() if v[1] is None} == {k for k, v in key(ih).items() if v[1] is None}
    assert H.load_hierarchy(spark, str(tmp_path / "renamed.bin")).get_layer_info() == ih.hierarchy.get_layer_info()
    with np.load(tmp_path / "renamed.bin") as f:
        assert f["zone_x"].tolist() == [1000.0 * (k // 5) for k in range(25)] and f["_meta_interaction_fn_hint"].item() == "inverse"
    plain = ih.hierarchy.save(str(tmp_path / "h"), backend="npz")
    with pytest.raises(H.StorageError, match="not an InteractionHierarchy"):
        H.load_interaction(spark, plain)
    for name, content in (("hdf", b"\x89HDF\r\n\x1a\n" + bytes(50)), ("text", b"no archive"), ("zip", b"PK\x03\x04 broken")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(H.StorageError):
            H.load_hierarchy(spark, str(tmp_path / name))


def test_other_inputs(spark):
    """Networks from arrays and compressed rows; numpy's integers as zones."""
    src, dst, cost = [0, 1, 2], np.array([1, 2, 3]), [10.0, 15.0, 20.0]
    one = H.Network.from_arrays(spark, src, dst, cost, node_ids=[0, 1, 2, 3, 9])
    assert one.n_edges == 3 and one.n_nodes == 5
    two = H.Network.from_csr(spark, [0, 1, 3, 5, 6], [1, 0, 2, 1, 3, 2], [10, 10, 15, 15, 20, 20])
    assert sorted(map(tuple, two.edges.collect())) == sorted(map(tuple, one.edges.collect()))
    for zones in (np.array([0, 3]), [np.int64(0), np.int32(3)]):
        h = H.Hierarchy(two, base_radius=np.float64(50), overlap_factor=2, zones=zones)
        assert h.n_zones == 2 and h.get_cost(np.int64(0), np.int64(3)) == 45
    with pytest.raises(TypeError, match="integers"):
        H.Network.from_arrays(spark, ["a"], ["b"], [1.0])


def test_bounds(spark):
    with pytest.raises(ValueError, match="at most"):
        H.generate_transport_network(spark, 60_000)
    with pytest.raises(ValueError, match="at most"):
        H.generate_large_spatial_network(spark, 10**9)


def test_storage_errors(spark, ih, tmp_path):
    with pytest.raises(FileNotFoundError):
        H.load_hierarchy(spark, str(tmp_path / "none"))
    (tmp_path / "other").mkdir()
    with pytest.raises(H.StorageError):
        H.load_hierarchy(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="backend"):
        H.save_hierarchy(ih.hierarchy, str(tmp_path / "b"), backend="tape")
    path = H.save_hierarchy(ih.hierarchy, str(tmp_path / "new"))
    spark.read.parquet(f"{path}/metadata").withColumn("format_version", F.lit(99)).toPandas()
    spark.createDataFrame([(99,)], "format_version int").write.mode("overwrite").parquet(f"{path}/metadata")
    with pytest.raises(H.StorageError, match="version"):
        H.load_hierarchy(spark, path)


def test_decay():
    assert H.power_law_interaction(math.inf) == 0 and H.exponential_interaction(math.inf) == 0
    assert H.power_law_interaction(0.0) == 5000.0**-2 and H.exponential_interaction(0.0) == 1


def test_range_join(spark):
    xy = np.random.RandomState(1).uniform(0, 100, (120, 2))
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "node_id long, x double, y double")
    got = {(r.src, r.dst) for r in pairs_within(p, 9.0).collect()}
    assert got == {(a, b) for a in range(120) for b in range(a + 1, 120) if math.dist(xy[a], xy[b]) <= 9.0}


@pytest.mark.parametrize("make", [lambda s: H.generate_random_spatial_network(s, 60, 50000.0, 5000.0), lambda s: H.generate_large_spatial_network(s, 60, 50000.0, 5000.0)])
def test_networks_are_connected(spark, make):
    n = make(spark)
    assert n.nodes.count() == 60
    reach = H.operators.sssp.ShortestPaths(n).search(spark.range(1).select(F.col("id").alias("src")))
    assert reach.count() == 60
    p = {r.node_id: (r.x, r.y) for r in n.nodes.collect()}
    assert p[0] == tuple(np.random.RandomState(42).uniform(0, 50000.0, size=(60, 2))[0])
    assert all(math.isclose(r.cost, math.dist(p[r.src], p[r.dst])) for r in n.edges.collect())


def test_delaunay():
    xy = np.random.RandomState(5).uniform(0, 10, (40, 2))
    edges = delaunay_edges(xy)
    # an edge belongs to the triangulation if some circle through its ends is empty: try all third points
    def empty(a, b):
        for c in range(40):
            if c in (a, b):
                continue
            (ax, ay), (bx, by), (cx, cy) = xy[a], xy[b], xy[c]
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            u = np.array([((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d, ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d])
            if (np.sqrt(((xy - u) ** 2).sum(1)) >= math.dist(u, xy[a]) * (1 - 1e-9)).all():
                return True
        return False

    assert edges == {(a, b) for a in range(40) for b in range(a + 1, 40) if empty(a, b)}


def test_running_accessibility(spark, ih, tmp_path):
    running = RunningAccessibility(ih, str(tmp_path / "run"))
    total = np.zeros(25)
    for k, zone in enumerate((3, 7)):
        changes = spark.createDataFrame([(zone, 2.0 + k)], "zone long, value double")
        running.add(changes, k)
        running.add(changes, k)  # a batch that runs again changes nothing
        total[zone] += 2.0 + k
    got = {r.zone: r.value for r in running.version(2).collect()}
    assert np.allclose([got[z] for z in range(25)], ih.matvec(total), atol=1e-12)


def test_stream(spark, ih, tmp_path):
    rows = [("2024-01-01 00:00:10", 1, 1.0), ("2024-01-01 00:00:20", 1, 2.0), ("2024-01-01 00:01:30", 2, 5.0)]
    df = spark.createDataFrame(rows, "ts string, zone long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    running = RunningAccessibility(ih, str(tmp_path / "run"))
    q = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).select("zone", "value").writeStream.foreachBatch(running.add).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    a = np.zeros(25)
    a[1], a[2] = 3, 5
    got = {r.zone: r.value for r in running.version(1).collect()}
    assert np.allclose([got[z] for z in range(25)], ih.matvec(a), atol=1e-12)
    w = windowed_activity(df, time="ts", zone="zone", value="value", every="1 minute", late="1 minute").collect()
    assert sorted((r.zone, r.value) for r in w) == [(1, 3.0), (2, 5.0)]
