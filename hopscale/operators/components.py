"""Connected components of an edge table by alternating large and small stars.

Each round is a grouped minimum and a join; rounds grow with the logarithm of the longest path. A
node's smallest neighbour is written before it is joined, so Spark can broadcast it when small and
split the edges of a hot node when not. Nothing but one row of counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.scratch import Scratch


def components(tmp: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges (u long, v long) -> (node, root): root is the smallest node of the component. Self edges, repeated edges and nulls do no harm."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = tmp.put(e, f"{name}0")
    k, mark = 0, None
    while True:
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (sign.n, sign.h) or not sign.n:
            break
        mark, k = (sign.n, sign.h), k + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tmp.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}{k}a")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tmp.put(large, f"{name}{k}b")
        low = tmp.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{k}c")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = tmp.put(small.distinct(), f"{name}{k}")
    # a star forest: every edge leads from a node to its root
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
