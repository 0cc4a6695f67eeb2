"""Dense baselines: all pairs, for validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.functions.decay import as_column
from hopscale.network import Network
from hopscale.operators.sssp import ShortestPaths
from hopscale.scratch import Scratch, small


def compute_dense_cost_matrix(network: Network, zones: DataFrame | list[int] | None = None, cutoff: float | None = None, backend: str = "auto") -> DataFrame:
    """(src, dst, cost) for every pair of zones (default: nodes); inf beyond the cutoff or without a path."""
    if zones is None:
        z = network.nodes.select(F.col("node_id").alias("zone"))
    elif isinstance(zones, DataFrame):
        z = zones.select("zone").distinct()
    else:
        z = network.spark.createDataFrame([(int(x),) for x in sorted(set(zones))], "zone long")
    return ShortestPaths(network, backend).matrix(z, cutoff)


def compute_dense_interaction_matrix(cost_matrix: DataFrame, interaction_fn: Callable | str) -> DataFrame:
    """(src, dst, value): the function of every cost, always double."""
    return cost_matrix.select("src", "dst", as_column(interaction_fn, F.col("cost")).cast("double").alias("value"))


def dense_matvec(interactions: DataFrame, activity: DataFrame) -> DataFrame:
    """(zone, value): the exact accessibility of every zone."""
    a = activity.groupBy(F.col("zone").alias("dst")).agg(F.sum("value").alias("a"))
    # written, so that its bytes are counted and the matrix is not shuffled for a small table
    a = small(Scratch(activity.sparkSession).put(a, "activity"))
    return interactions.join(a, "dst", "left").groupBy(F.col("src").alias("zone")).agg(F.sum(F.col("value") * F.coalesce("a", F.lit(0.0))).alias("value"))
