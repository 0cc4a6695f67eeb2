"""A weighted undirected network as two DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType


def edge_faults(edges: DataFrame) -> DataFrame:
    """One row on edges (src, dst, cost): edges; pairs of nodes that have several (twice); costs that are missing (none) or not finite and positive or 0 (bad, worst); pairs without an end (open)."""
    c, low, high = F.col("cost"), F.least("src", "dst"), F.greatest("src", "dst")
    bad = c.isNotNull() & (F.isnan(c) | (c < 0) | (c == float("inf")))
    ends = F.col("src").isNotNull() & F.col("dst").isNotNull()
    # one row for each pair: more than one edge between two nodes shows as a count
    pairs = edges.groupBy(F.when(ends, low).alias("a"), F.when(ends, high).alias("z")).agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("none"), F.count_if(bad).alias("bad"), F.max(F.when(bad, c)).alias("worst"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return pairs.agg(total("n").alias("edges"), F.count_if((F.col("n") > 1) & F.col("a").isNotNull()).alias("twice"), total("none").alias("none"), total("bad").alias("bad"), F.max("worst").alias("worst"), F.count_if(F.col("a").isNull()).alias("open"))


class Network:
    """nodes (node_id, x?, y?) and edges (src, dst, cost), one row for each undirected edge.

    Without nodes, the endpoints are the nodes; given nodes are completed by endpoints they lack.
    Everything is checked at once, eagerly.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.spark = edges.sparkSession
        if not {"src", "dst"} <= set(edges.columns):
            raise TypeError("edges of an undirected simple graph need the columns src and dst")
        given = [edges.schema["src"].dataType, edges.schema["dst"].dataType]
        if nodes is not None:
            given.append(nodes.schema["node_id"].dataType)
        if not all(isinstance(t, IntegralType) for t in given):
            raise TypeError(f"node ids must be integers, got {[t.simpleString() for t in given]}")
        if "cost" not in edges.columns:
            raise ValueError("every edge is missing a 'cost'")
        if not isinstance(edges.schema["cost"].dataType, NumericType):
            raise ValueError(f"invalid cost: type {edges.schema['cost'].dataType.simpleString()}")
        both = F.col("src").isNotNull() & F.col("dst").isNotNull()
        e = edges.select(F.when(both, F.least("src", "dst")).cast("long").alias("src"), F.when(both, F.greatest("src", "dst")).cast("long").alias("dst"), F.col("cost").cast("double").alias("cost"))
        ends = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        if nodes is None:
            n = ends.select("node_id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
        else:
            xy = [(F.col(c).cast("double") if c in nodes.columns else F.lit(None).cast("double")).alias(c) for c in ("x", "y")]
            n = nodes.select(F.col("node_id").cast("long").alias("node_id"), *xy)
            n = n.unionByName(ends.join(n.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)
        self.edges, self.nodes = e, n
        self.n_edges = self._check()
        self.n_nodes = self.nodes.count()

    @classmethod
    def from_arrays(cls, spark: SparkSession, src, dst, cost, node_ids=None, x=None, y=None) -> Network:
        """A network from arrays, lists or pandas columns of an edge list, one entry for each undirected edge; nodes without edges in node_ids."""
        arrow = lambda **c: spark.createDataFrame(pa.table({k: pa.array(np.asarray(v)) for k, v in c.items() if v is not None}))
        edges = arrow(src=src, dst=dst, cost=cost)
        return cls(edges, None if node_ids is None else arrow(node_id=node_ids, x=x, y=y))

    @classmethod
    def from_csr(cls, spark: SparkSession, indptr, indices, data, node_ids=None) -> Network:
        """A network from a symmetric matrix by compressed rows; of each pair the upper entry counts. Rows are nodes 0, 1, ... or node_ids."""
        n = len(indptr) - 1
        ids = np.arange(n) if node_ids is None else np.asarray(node_ids)
        src, dst = np.repeat(np.arange(n), np.diff(indptr)), np.asarray(indices)
        up = src <= dst
        return cls.from_arrays(spark, ids[src[up]], ids[dst[up]], np.asarray(data, np.float64)[up], ids)

    def _check(self) -> int:
        r = edge_faults(self.edges).first()
        if r.open:
            raise TypeError("node ids must be integers, got null")
        if r.twice:
            raise TypeError(f"the network must be an undirected simple graph; {r.twice} pairs of nodes have several edges")
        if r.none:
            raise ValueError(f"{r.none} edges are missing a 'cost'")
        if r.bad:
            raise ValueError(f"invalid cost {r.worst} ({r.bad} edges): costs must be finite and not negative")
        if not r.edges and self.nodes.isEmpty():
            raise ValueError("the network is empty")
        return r.edges

    @property
    def adjacency(self) -> DataFrame:
        """Both directions of every edge."""
        back = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
        return self.edges.unionByName(back)

    def degrees(self) -> DataFrame:
        """(node_id, degree)."""
        d = self.adjacency.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
