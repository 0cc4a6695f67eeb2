"""Network generators.

Positions of random networks come from numpy's RandomState on the driver, so that they match the
published sequences, up to a checked number; they travel as Arrow. Pairs within a radius come from a range join over grid cells of that size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale.network import Network
from hopscale.operators.components import components
from hopscale.scratch import Scratch, small


def _check(**values) -> None:
    for name, (x, least) in values.items():
        if least is not None and (not isinstance(x, int) or isinstance(x, bool) or x < least):
            raise ValueError(f"{name} must be an integer of at least {least}, got {x!r}")
        if least is None and not x > 0:
            raise ValueError(f"{name} must be positive, got {x!r}")


def generate_grid_network(spark: SparkSession, n_x: int, n_y: int, spacing: float = 1000.0) -> Network:
    """n_x times n_y lattice; node i * n_y + j at (i, j) * spacing."""
    _check(n_x=(n_x, 1), n_y=(n_y, 1), spacing=(spacing, None))
    i, j = F.floor(F.col("id") / n_y), F.col("id") % n_y
    n = spark.range(n_x * n_y).select(F.col("id").alias("node_id"), (i * float(spacing)).alias("x"), (j * float(spacing)).alias("y"))
    ids = spark.range(n_x * n_y)
    down = ids.where(i < n_x - 1).select(F.col("id").alias("src"), (F.col("id") + n_y).alias("dst"))
    right = ids.where(j < n_y - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return Network(down.unionByName(right).withColumn("cost", F.lit(float(spacing))), n)


#: Points come from one sequence of random numbers, so the driver draws them: 24 bytes each.
MAX_POINTS = 20_000_000
#: The triangulation is made on the driver, in time that grows with the square of the points.
MAX_TRIANGULATED = 50_000


def _draw(n: int, area: float, seed: int, most: int = MAX_POINTS) -> np.ndarray:
    if n > most:
        raise ValueError(f"n_zones must be at most {most}, got {n}: the points are drawn on the driver")
    return np.random.RandomState(seed).uniform(0, area, size=(n, 2))


def _points(spark: SparkSession, xy: np.ndarray) -> DataFrame:
    x, y = np.ascontiguousarray(xy.T)
    return spark.createDataFrame(pa.table({"node_id": np.arange(len(xy)), "x": x, "y": y}))


#: Points of a cell that are compared with its neighbours in one piece; of fuller cells, pieces of about that many.
CELL_POINTS = 4096
#: Rows dealt to a task of the join.
TASK_ROWS = 1_000_000
_AHEAD = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def pairs_within(points: DataFrame, radius: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """(src, dst, cost), src < dst: pairs at most `radius` apart. Of two neighbouring cells one is dealt to the other, so a pair is met once."""
    met = _met(points, points, radius, _AHEAD, cell_points)
    met = met.where(F.when(F.col("own"), F.col("src") < F.col("dst")).otherwise(F.col("src") != F.col("dst")))
    return met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.sqrt("squares").alias("cost"))


def between(some: DataFrame, others: DataFrame, radius: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """(src, dst, cost): pairs of points of two tables at most `radius` apart."""
    met = _met(some, others, radius, [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)], cell_points)
    return met.select("src", "dst", F.sqrt("squares").alias("cost"))


def _met(some: DataFrame, others: DataFrame, radius: float, steps: list[tuple[int, int]], cell_points: int) -> DataFrame:
    """(src, dst, squares, own): pairs whose squares' sum is at most the radius's square. A range join: equal cells after the others are dealt by `steps`; own marks those of one cell.

    The work is the pairs of a cell and not its bytes, so the cells are dealt to tasks by number and never
    broadcast, and a crowded cell is dealt in pieces, each with all of the others.
    """
    tmp, wide = Scratch(some.sparkSession), float(radius) * (1 + 1e-9)  # differences that round to the radius stay neighbours
    cell = lambda c: F.floor(F.col(c) / wide).cast("long")
    a = some.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = others.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("bx0"), cell("y").alias("by0"))
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("d")
    b = b.select("*", step).select("dst", "bx", "by", (F.col("bx0") + F.col("d.dx")).alias("cx"), (F.col("by0") + F.col("d.dy")).alias("cy"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    cells = tmp.put(a.groupBy("cx", "cy").agg(F.count("*").alias("n")), "cells")
    total = cells.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if (total.most or 0) > cell_points:
        pieces = small(cells.where(F.col("n") > cell_points).select("cx", "cy", F.ceil(F.col("n") / cell_points).cast("int").alias("pieces")))
        count = F.coalesce("pieces", F.lit(1))
        a = a.join(pieces, ["cx", "cy"], "left").withColumn("piece", F.pmod(F.xxhash64("src"), count).cast("int")).drop("pieces")
        b = b.join(pieces, ["cx", "cy"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1))).drop("pieces")
    else:
        a, b = a.withColumn("piece", F.lit(0)), b.withColumn("piece", F.lit(0))
    tasks = max(4 * some.sparkSession.sparkContext.defaultParallelism, (1 + len(steps)) * (total.n or 0) // TASK_ROWS)
    deal = lambda df: df.repartition(tasks, "cx", "cy", "piece")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = deal(a).join(deal(b).hint("merge"), ["cx", "cy", "piece"]).select("src", "dst", (dx * dx + dy * dy).alias("squares"), "own")
    return met.where(F.col("squares") <= float(radius) * float(radius))


def _connected(tmp: Scratch, points: DataFrame, edges: DataFrame, closest: bool, radius: float) -> DataFrame:
    """edges and, for each component but the largest, one to the largest: from its smallest node or, if `closest`, from its closest one.

    The nearest node of the largest component is looked for within twice the radius, then four times, and
    so on; only components without a hit go on, so no round looks at all pairs unless one is that far away.
    """
    root = components(tmp, edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "cc")
    of = tmp.put(points.join(root, F.col("node_id") == F.col("node"), "left").select("node_id", "x", "y", F.coalesce("root", "node_id").alias("root")), "of")
    sizes = of.groupBy("root").agg(F.count("*").alias("n"))
    main = sizes.orderBy(F.desc("n"), "root").first()
    if main is None or main.n == points.count():
        return edges
    big, left = of.where(F.col("root") == main.root), of.where(F.col("root") != main.root)
    if not closest:
        left = left.groupBy("root").agg(F.min(F.struct("node_id", "x", "y")).alias("p")).select("root", "p.*")
    left, k = tmp.put(left, "left0"), 0
    while not left.isEmpty():
        k, radius = k + 1, 2 * radius
        near = between(left, big, radius).join(left.select(F.col("node_id").alias("src"), "root"), "src")
        # within the radius none is missed, so the least of them is the nearest
        best = tmp.put(near.groupBy("root").agg(F.min(F.struct("cost", F.col("src").alias("u"), F.col("dst").alias("v"))).alias("e")), f"ties{k}")
        edges = edges.unionByName(best.select(F.least("e.u", "e.v").alias("src"), F.greatest("e.u", "e.v").alias("dst"), F.col("e.cost").alias("cost")))
        left = tmp.put(left.join(best.select("root"), "root", "left_anti").select("root", "node_id", "x", "y"), f"left{k}")
    return edges


def generate_random_spatial_network(spark: SparkSession, n_zones: int, area_size: float = 100000.0, connection_radius: float = 15000.0) -> Network:
    """Uniform points, edges within a radius; other components hang on the largest by their smallest node."""
    _check(n_zones=(n_zones, 1), area_size=(area_size, None), connection_radius=(connection_radius, None))
    tmp = Scratch(spark)
    p = tmp.put(_points(spark, _draw(n_zones, area_size, 42)), "points")
    return Network(tmp.put(_connected(tmp, p, tmp.put(pairs_within(p, connection_radius), "pairs"), False, connection_radius), "edges"), p)


def generate_large_spatial_network(spark: SparkSession, n_zones: int, area_size: float = 100000.0, connection_radius: float | None = None, seed: int = 42) -> Network:
    """The same with a radius of three mean spacings by default; components are tied by their closest pairs."""
    _check(n_zones=(n_zones, 1), area_size=(area_size, None))
    radius = area_size / math.sqrt(n_zones) * 3 if connection_radius is None else connection_radius
    tmp = Scratch(spark)
    p = tmp.put(_points(spark, _draw(n_zones, area_size, seed)), "points")
    return Network(tmp.put(_connected(tmp, p, tmp.put(pairs_within(p, radius), "pairs"), True, radius), "edges"), p)


def delaunay_edges(xy: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation, by incremental insertion into a covering triangle (Bowyer and Watson)."""
    n = len(xy)
    span = 1e4 * (float(np.ptp(xy)) or 1.0)
    mid = xy.mean(0)
    pts = np.vstack([xy, mid + [-span, -span], mid + [span, -span], mid + [0, span]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        """Centre and squared radius of each triangle's circle."""
        a, b, c = pts[t[:, 0]], pts[t[:, 1]] - pts[t[:, 0]], pts[t[:, 2]] - pts[t[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        u = np.column_stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb]) / d[:, None]
        return np.column_stack([a + u, (u**2).sum(1)])

    circ = circles(tri)
    for k in range(n):
        inside = ((circ[:, :2] - pts[k]) ** 2).sum(1) < circ[:, 2] * (1 + 1e-12)
        hole = tri[inside]
        sides = np.sort(np.concatenate([hole[:, [0, 1]], hole[:, [1, 2]], hole[:, [2, 0]]]), axis=1)
        rim, times = np.unique(sides, axis=0, return_counts=True)
        rim = rim[times == 1]
        fresh = np.column_stack([rim, np.full(len(rim), k)])
        tri, circ = np.vstack([tri[~inside], fresh]), np.vstack([circ[~inside], circles(fresh)])
    tri = tri[(tri < n).all(1)]
    return {(int(min(a, b)), int(max(a, b))) for t in tri for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}


def generate_transport_network(spark: SparkSession, n_zones: int, area_size: float = 100000.0, seed: int = 42) -> Network:
    """Delaunay triangulation of uniform points, made on the driver: for MAX_TRIANGULATED zones at most."""
    _check(n_zones=(n_zones, 3), area_size=(area_size, None))
    xy = _draw(n_zones, area_size, seed, MAX_TRIANGULATED)
    edges = [(a, b, float(math.dist(xy[a], xy[b]))) for a, b in sorted(delaunay_edges(xy))]
    return Network(spark.createDataFrame(edges, "src long, dst long, cost double"), _points(spark, xy))
