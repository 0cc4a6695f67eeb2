"""Queries over the driver's tables and the SQL that checks them.

The network is a grid of the suppliers: W = floor(sqrt(n - 1)) + 1 columns, edges to the right and down,
cost 1000 + |difference of whole account balances| mod 1000. Activity is the quantity sold by supplier.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale.functions.decay import exponential_interaction, power_law_interaction
from hopscale.network import Network, edge_faults
from hopscale.operators.components import components
from hopscale.operators.dense import compute_dense_cost_matrix, compute_dense_interaction_matrix, dense_matvec
from hopscale.operators.hierarchy import Hierarchy, extent, violations
from hopscale.operators.interaction import InteractionHierarchy
from hopscale.operators.sssp import ShortestPaths
from hopscale.plans.oracle import ORACLES
from hopscale.scratch import Scratch
from hopscale.sources.generators import generate_grid_network, generate_large_spatial_network, generate_random_spatial_network, generate_transport_network, pairs_within
from hopscale.sources.storage import load_hierarchy, load_interaction, save_hierarchy, save_interaction

BASE, OFFSET = 3000.0, 2000.0
_BUILT: dict[tuple, object] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """The supplier table's files with their sizes and times, so that a folder whose content changes is another one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/supplier.parquet")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    """What several queries share is built once for an application and a folder with that content."""
    key = (spark.sparkContext.applicationId, sf_dir, what, _files(spark, sf_dir))
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.floor("s_acctbal").cast("long").alias("b"))
    w = s.agg((F.floor(F.sqrt(F.count("*") - 1)).cast("long") + 1).alias("w"))
    u = s.crossJoin(F.broadcast(w))  # one row
    to = u.select("k", "b", F.explode(F.when((F.col("k") + 1) % F.col("w") != 0, F.array(F.col("k") + 1, F.col("k") + F.col("w"))).otherwise(F.array(F.col("k") + F.col("w")))).alias("dst"))
    v = s.select(F.col("k").alias("dst"), F.col("b").alias("b2"))
    return to.join(v, "dst").select(F.col("k").alias("src"), "dst", (1000 + F.abs(F.col("b") - F.col("b2")) % 1000).cast("double").alias("cost"))


def network(spark: SparkSession, sf_dir: str) -> Network:
    def make() -> Network:
        nodes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("node_id"))
        tmp = Scratch(spark)
        return Network(tmp.put(_edges(spark, sf_dir), "edges"), tmp.put(nodes, "nodes"))

    return _once(spark, sf_dir, "network", make)


def hierarchy(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return _once(spark, sf_dir, "hierarchy", lambda: Hierarchy(network(spark, sf_dir), base_radius=BASE))


def _decay(c):
    return F.lit(1.0) / (c + OFFSET)


def interaction(spark: SparkSession, sf_dir: str) -> InteractionHierarchy:
    return _once(spark, sf_dir, "interaction", lambda: InteractionHierarchy(hierarchy(spark, sf_dir), _decay))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.col("l_suppkey").alias("zone")).agg(F.sum("l_quantity").cast("long").cast("double").alias("value"))


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rhs = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return li.groupBy(F.col("l_suppkey").alias("zone"), rhs.alias("rhs")).agg(F.sum("l_quantity").cast("long").cast("double").alias("value"))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- network and searches --------------------------------------------------------------------------


def net_edges(spark, sf_dir):
    return network(spark, sf_dir).edges


def net_adjacency(spark, sf_dir):
    return network(spark, sf_dir).adjacency


def net_degree(spark, sf_dir):
    return network(spark, sf_dir).degrees()


def grid_network(spark, sf_dir):
    return generate_grid_network(spark, 12, 9, 500.0).edges


def range_join_edges(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    p = c.select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7 % 10007).cast("double").alias("y"))
    # halves up, as costs are positive; a decimal text of every cost, which Spark's round goes through, takes most of the time
    return pairs_within(p, 150.0).withColumn("cost", F.floor(F.col("cost") * 1e6 + 0.5) / 1e6)


def sssp_single(spark, sf_dir):
    return ShortestPaths(network(spark, sf_dir)).search(spark.range(1).select(F.col("id").alias("src")))


def sssp_cutoff(spark, sf_dir):
    src = network(spark, sf_dir).nodes.select(F.col("node_id").alias("src"))
    return ShortestPaths(network(spark, sf_dir)).search(src, 4500.0)


def sssp_rounds(spark, sf_dir):
    src = network(spark, sf_dir).nodes.select(F.col("node_id").alias("src"))
    return ShortestPaths(network(spark, sf_dir), "dataframe").search(src, 6000.0)


def dense_cost(spark, sf_dir):
    return compute_dense_cost_matrix(network(spark, sf_dir), cutoff=9000.0)


def network_extent(spark, sf_dir):
    n = network(spark, sf_dir)
    return spark.createDataFrame([(extent(ShortestPaths(n), n.nodes.select(F.col("node_id").alias("zone")), n.n_nodes),)], "extent double")


def edge_problems(spark, sf_dir):
    """What the validation counts on the network's edges with faults put into some."""
    e = network(spark, sf_dir).edges
    cost = F.when(F.col("src") % 7 == 0, F.lit(None)).when(F.col("src") % 7 == 1, -F.col("cost")).when(F.col("src") % 7 == 2, F.lit(float("inf"))).when(F.col("src") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("cost"))
    twice = e.where("src % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    return edge_faults(e.withColumn("cost", cost).unionByName(twice)).select("edges", "twice", "none", "bad", "open")


def components_cut(spark, sf_dir):
    """Components of the network without its dearer edges."""
    e = network(spark, sf_dir).edges.where("cost < 1300")
    return components(Scratch(spark), e.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def layer_radii(spark, sf_dir):
    return hierarchy(spark, sf_dir).layers


# -- hierarchy -------------------------------------------------------------------------------------


def layer_costs(spark, sf_dir):
    return hierarchy(spark, sf_dir).costs


def layer_reps(spark, sf_dir):
    return hierarchy(spark, sf_dir).reps


def layer_groups(spark, sf_dir):
    return hierarchy(spark, sf_dir).groups


def layer_info(spark, sf_dir):
    return hierarchy(spark, sf_dir).layer_info()


def densities(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    return spark.createDataFrame([(h.get_density(), h.get_finest_layer_density(), interaction(spark, sf_dir).get_density())], "density double, finest double, interaction double")


def nesting_check(spark, sf_dir):
    return hierarchy(spark, sf_dir).nesting_violations()


def nesting_broken(spark, sf_dir):
    """Violations that a wrong table of groups has: on the coarsest layer every third zone stands for itself."""
    h = hierarchy(spark, sf_dir)
    last = (F.col("layer") == len(h.radii) - 1) & (F.col("zone") % 3 == 0)
    return violations(h.groups.withColumn("rep", F.when(last, F.col("zone")).otherwise(F.col("rep"))))


def nodes_explored(spark, sf_dir):
    return spark.createDataFrame([(hierarchy(spark, sf_dir).total_nodes_explored,)], "explored long")


def gap_fill_pairs(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    up = F.col("radius") * h.overlap_factor
    return h.costs.join(h.layers.where("cutoff is not null"), "layer").where(F.col("cost") > up).select("layer", "src", "dst", "cost")


def get_cost_pairs(spark, sf_dir):
    """All ordered pairs of zones: the result's own size."""
    return hierarchy(spark, sf_dir).get_all_costs()


def _subset(spark: SparkSession, sf_dir: str) -> Hierarchy:
    n = network(spark, sf_dir)
    even = n.nodes.where("node_id % 2 = 0").select(F.col("node_id").alias("zone"))
    return _once(spark, sf_dir, "subset", lambda: Hierarchy(n, base_radius=BASE, zones=even))


def zone_subset_costs(spark, sf_dir):
    """Costs of all layers of the subset's hierarchy."""
    return _subset(spark, sf_dir).costs


# -- decay and interaction -------------------------------------------------------------------------


def decay_power(spark, sf_dir):
    c = hierarchy(spark, sf_dir).costs.select("layer", "src", "dst", power_law_interaction("cost", 2.0, -1.5, 1000.0).alias("value"))
    return _rounded(c, "value", digits=12)


def decay_exponential(spark, sf_dir):
    c = hierarchy(spark, sf_dir).costs.select("layer", "src", "dst", exponential_interaction("cost", 5e-4).alias("value"))
    return _rounded(c, "value", digits=12)


def net_operator(spark, sf_dir):
    return _rounded(interaction(spark, sf_dir).interactions, "value", "correction", "net", digits=12)


def interaction_info(spark, sf_dir):
    return interaction(spark, sf_dir).layer_info()


def accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interaction(spark, sf_dir).apply(activity(spark, sf_dir)), "value")


def accessibility_multi(spark, sf_dir):
    return _rounded(interaction(spark, sf_dir).matmat(_multi(spark, sf_dir)), "value")


def interaction_row(spark, sf_dir):
    return _rounded(interaction(spark, sf_dir).row(3), "value", digits=10)


def without_self(spark, sf_dir):
    """The operator without a zone's interaction with itself on the finest layer."""
    return _rounded(InteractionHierarchy(hierarchy(spark, sf_dir), _decay, self_interaction=False).interactions, "value", "correction", "net", digits=12)


def accessibility_transposed(spark, sf_dir):
    return _rounded(interaction(spark, sf_dir).rmatvec(activity(spark, sf_dir)), "value")


def top_zones(spark, sf_dir):
    return accessibility(spark, sf_dir).orderBy(F.desc("value"), "zone").limit(5)


def accessibility_stats(spark, sf_dir):
    a = accessibility(spark, sf_dir)
    made = a.agg(F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.max_by("zone", F.struct("value", -F.col("zone"))).alias("best"))
    return _rounded(made, "high", "low", "mean", "spread", digits=4)


def dense_accessibility(spark, sf_dir):
    full = compute_dense_interaction_matrix(compute_dense_cost_matrix(network(spark, sf_dir)), _decay)
    return _rounded(dense_matvec(full, activity(spark, sf_dir)), "value")


def approx_error(spark, sf_dir):
    exact = dense_accessibility(spark, sf_dir).withColumnRenamed("value", "exact")
    both = accessibility(spark, sf_dir).join(exact, "zone")
    return both.agg(F.round(F.avg(F.abs(F.col("value") - F.col("exact")) / F.col("exact")), 6).alias("mean_relative_error"))


def parquet_roundtrip(spark, sf_dir):
    ih = interaction(spark, sf_dir)
    path = save_interaction(ih, f"{Scratch(spark).path}/stored", include_network=True, interaction_fn_hint="(c + 2000) ** -1")
    return _rounded(load_interaction(spark, path).apply(activity(spark, sf_dir)), "value")


def stored_hierarchy(spark, sf_dir):
    """Costs of a hierarchy that was stored and loaded again."""
    h = hierarchy(spark, sf_dir)
    return load_hierarchy(spark, save_hierarchy(h, f"{Scratch(spark).path}/stored")).costs


def stored_network(spark, sf_dir):
    """Degrees of the network of a hierarchy that was stored with it and loaded again."""
    h = hierarchy(spark, sf_dir)
    return load_hierarchy(spark, save_hierarchy(h, f"{Scratch(spark).path}/stored", include_network=True)).network.degrees()


def stored_coordinates(spark, sf_dir):
    """Coordinates of the zones that are stored beside a hierarchy: here a place on the grid."""
    n = network(spark, sf_dir)
    nodes = n.nodes.select("node_id", (F.col("node_id") * 10).cast("double").alias("x"), (F.col("node_id") + 0.5).cast("double").alias("y"))
    even = nodes.where("node_id % 2 = 0").select(F.col("node_id").alias("zone"))
    path = save_hierarchy(Hierarchy(Network(n.edges, nodes), base_radius=BASE, zones=even), f"{Scratch(spark).path}/stored")
    return spark.read.parquet(f"{path}/zone_coords").select("zone", "x", "y")


def stored_single_file(spark, sf_dir):
    """Accessibility by an interaction that went through a single file."""
    ih = interaction(spark, sf_dir)
    with tempfile.TemporaryDirectory() as own:  # the driver's own file, read back by the driver
        back = load_interaction(spark, save_interaction(ih, f"{own}/one", backend="npz"))
    return _rounded(back.apply(activity(spark, sf_dir)), "value")


# -- generators ------------------------------------------------------------------------------------


def random_network(spark, sf_dir):
    return generate_random_spatial_network(spark, 150, 50000.0, 5000.0).edges


def large_network(spark, sf_dir):
    return generate_large_spatial_network(spark, 2000).edges


def transport_network(spark, sf_dir):
    return generate_transport_network(spark, 300).edges


def generated_facts(spark, sf_dir):
    """Of each generated network: its size, how it hangs together, and how many edges are wrong by its own rule."""
    made = [("random", 150, 5000.0, generate_random_spatial_network(spark, 150, 50000.0, 5000.0)), ("large", 500, 100000.0 / math.sqrt(500) * 3, generate_large_spatial_network(spark, 500)), ("transport", 300, float("inf"), generate_transport_network(spark, 300))]
    rows = []
    for name, n, radius, net in made:
        at = lambda end: net.nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"))  # noqa: E731, B023
        e = net.edges.join(at("src"), "src").join(at("dst"), "dst")
        dist = F.sqrt(F.pow(F.col("srcx") - F.col("dstx"), 2) + F.pow(F.col("srcy") - F.col("dsty"), 2))
        wrong = e.where((F.abs(dist - F.col("cost")) > 1e-9 * dist) | (F.col("src") >= F.col("dst"))).count()
        parts = components(Scratch(spark), net.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select("root").distinct().count()
        close = pairs_within(net.nodes, radius).count() if radius < float("inf") else None
        # a triangulation of points in general position with h on the hull has 3 n - 3 - h edges
        kept = net.edges.where(F.col("cost") <= radius).count() == close if close is not None else 2 * n < net.n_edges <= 3 * n - 6
        rows.append((name, net.nodes.count(), parts, wrong, kept))
    return spark.createDataFrame(rows, "name string, n_nodes long, n_components long, n_wrong long, complete boolean")


QUERIES = {
    f.__name__: f
    for f in (
        *(net_edges, net_adjacency, net_degree, grid_network, range_join_edges, sssp_single, sssp_cutoff, sssp_rounds, dense_cost, edge_problems, components_cut),
        *(network_extent, layer_radii, layer_costs, layer_reps, layer_groups, layer_info, densities, nesting_check, nesting_broken, nodes_explored, gap_fill_pairs),
        *(get_cost_pairs, zone_subset_costs, decay_power, decay_exponential, net_operator, without_self, interaction_info, accessibility, accessibility_transposed),
        *(accessibility_multi, interaction_row, top_zones, accessibility_stats, dense_accessibility, approx_error, parquet_roundtrip),
        *(stored_hierarchy, stored_network, stored_coordinates, stored_single_file),
        *(random_network, large_network, transport_network, generated_facts),
    )
}
__all__ = ["ORACLES", "QUERIES"]
