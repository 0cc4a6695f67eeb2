"""Shortest paths from many sources, within an inclusive cutoff.

`broadcast`: the adjacency arrays go to every executor and each task searches from its sources: within a
cutoff by Dijkstra one by one, without one in waves from a block of sources at a time.
Only for networks of at most `max_edges` edges and as many nodes, a bound that is checked.
`dataframe`: rounds of a join with the adjacency and a grouped minimum; for networks of any size. The
cutoff prunes inside every round. With m the least cost of a round's new entries, later rounds find
nothing below m; entries below m less the largest edge cost border on none of the new ones. They are
settled: written once more and never read again, so a round shuffles the open entries only.
`auto` takes the first where the bound allows it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.network import Network
from hopscale.scratch import Scratch

MAX_BROADCAST_EDGES = 2_000_000
#: Names of single-node backends are accepted and leave the choice to the engine.
_AUTO = ("auto", "scipy", "networkx", "graph-tool")
STRATEGIES = ("broadcast", "dataframe")


def pick_strategy(name: str, n_edges: int, max_edges: int = MAX_BROADCAST_EDGES) -> str:
    """The strategy of that name; n_edges is the larger of the numbers of edges and nodes."""
    if name == "broadcast" and n_edges > max_edges:
        raise ValueError(f"the network has {n_edges} edges or nodes; backend 'broadcast' takes up to {max_edges}")
    if name in STRATEGIES:
        return name
    if name in _AUTO:
        return "broadcast" if n_edges <= max_edges else "dataframe"
    raise ValueError(f"Unknown backend {name!r}; choose from {', '.join((*_AUTO, *STRATEGIES))}")


def explore(starts: list[int], ends: list[int], costs: list[float], source: int, cutoff: float) -> dict[int, float]:
    """Distances from a source to all nodes within the cutoff, over adjacency arrays."""
    done: dict[int, float] = {}
    best = {source: 0.0}
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        for k in range(starts[u], starts[u + 1]):
            v, nd = ends[k], d + costs[k]
            if nd <= cutoff and v not in done and nd < best.get(v, math.inf):
                best[v] = nd
                heapq.heappush(heap, (nd, v))
    return done


def explore_many(starts: np.ndarray, ends: np.ndarray, costs: np.ndarray, sources: np.ndarray, step: float) -> np.ndarray:
    """(sources, nodes): distances from several sources to all nodes, inf without a path.

    A wave takes all open entries of at most the least one's distance plus `step`. Up to the least edge cost
    none of them can become shorter any more; with a longer step those that do are opened again. Either way
    a distance is the least sum over paths from the source on, as in `explore`.
    """
    n, degree = len(starts) - 1, np.diff(starts)
    dist = np.full(len(sources) * n, np.inf)
    waits, turn = np.zeros(dist.size, bool), np.empty(dist.size, np.int32)
    waiting = np.arange(len(sources)) * n + sources
    dist[waiting] = 0.0
    while waiting.size:
        d = dist[waiting]
        near = d <= d.min() + step
        now, d, waiting = waiting[near], d[near], waiting[~near]
        waits[now] = False
        v = now % n
        many = degree[v]
        edge = np.repeat(starts[v] - np.cumsum(many) + many, many) + np.arange(many.sum())
        to, nd = np.repeat(now - v, many) + ends[edge], np.repeat(d, many) + costs[edge]
        less = nd < dist[to]
        to, nd = to[less], nd[less]
        np.minimum.at(dist, to, nd)
        to = to[~waits[to]]
        # of an entry that several edges reach, one stays
        order = np.arange(len(to), dtype=np.int32)
        turn[to] = order
        to = to[turn[to] == order]
        waits[to] = True
        waiting = np.concatenate((waiting, to))
    return dist.reshape(len(sources), n)


#: Entries (sources times nodes) that a block of sources holds at once, 13 bytes each.
BLOCK = 1 << 21
#: Rows of a batch that goes back to Spark.
BATCH = 1 << 17


def _lists(shared) -> tuple:
    """(starts, ends, costs) of a broadcast adjacency as lists. A worker keeps a broadcast value between tasks, so they are made once a worker."""
    _, *rest, made = shared.value
    if not made:
        made["lists"] = tuple(a.tolist() for a in rest)
    return made["lists"]


def _each(shared, at: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the nodes found, their distances) for each source, which are places too."""
    ids, starts, ends, costs, _ = shared.value
    if cutoff < math.inf:
        own = _lists(shared)
        for s in at.tolist():
            found = explore(*own, s, cutoff)
            yield np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))
        return
    step, block = max(costs.min(), costs.mean() / 2) if len(costs) else 0.0, max(1, BLOCK // len(ids))
    for i in range(0, len(at), block):
        for row in explore_many(starts, ends, costs, at[i : i + block], step):
            reached = np.flatnonzero(row < math.inf)
            yield reached, row[reached]


def _batches(src: int, dst: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(dst), BATCH):
        d = dst[i : i + BATCH]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), src)), pa.array(d), pa.array(cost[i : i + BATCH])], ["src", "dst", "cost"])


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ids in the sorted ids of the nodes; of others, one behind the last."""
    at = np.searchsorted(ids, wanted)
    return np.where(ids[np.minimum(at, len(ids) - 1)] == wanted, at, len(ids))


class ShortestPaths:
    """Searches over one network; what is broadcast is made once."""

    def __init__(self, network: Network, strategy: str = "auto", partitions: int | None = None):
        self.network, self.spark = network, network.spark
        self.strategy = pick_strategy(strategy, max(network.n_edges, network.n_nodes))
        self.partitions = partitions or max(2, self.spark.sparkContext.defaultParallelism)
        self._arrays = None

    def _adjacency(self):
        if self._arrays is None:
            t = self.network.adjacency.toArrow()
            ids = np.sort(self.network.nodes.select("node_id").toArrow().column(0).to_numpy())
            src, dst = (np.searchsorted(ids, t.column(k).to_numpy()) for k in (0, 1))
            order = np.argsort(src, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=len(ids)))))
            self._arrays = self.spark.sparkContext.broadcast((ids, starts, dst[order], t.column(2).to_numpy()[order], {}))
        return self._arrays

    def search(self, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
        """sources (src) -> (src, dst, cost) for every node within the cutoff, the source itself at 0."""
        if self.strategy == "dataframe":
            return self._rounds(sources, cutoff)
        shared, limit = self._adjacency(), math.inf if cutoff is None else float(cutoff)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = shared.value[0]
            for b in batches:
                at = _places(ids, b.column(0).to_numpy())
                at = at[at < len(ids)]
                for s, (found, cost) in zip(ids[at], _each(shared, at, limit), strict=True):
                    yield from _batches(s, ids[found], cost)

        return sources.select(F.col("src").cast("long")).repartition(self.partitions, "src").mapInArrow(run, "src long, dst long, cost double")

    def matrix(self, zones: DataFrame, cutoff: float | None = None, most: int = MAX_BROADCAST_EDGES) -> DataFrame:
        """zones (zone) -> (src, dst, cost) for every pair of them, inf beyond the cutoff or without a path.

        A task makes all of a source's row from one search, so no pair is shuffled or joined. Only searches in
        rounds, and more than `most` zones, go through a join of all pairs.
        """
        src, z = zones.select(F.col("zone").cast("long").alias("src")), None
        if self.strategy == "broadcast":
            z = zones.select(F.col("zone").cast("long")).limit(most + 1).toArrow().column(0).to_numpy()
        if z is None or len(z) > most:
            every = src.crossJoin(zones.select(F.col("zone").cast("long").alias("dst")))  # the result's own size
            # merged, as what a search finds is far more than Spark expects and must not be broadcast
            return every.join(self.search(src, cutoff).hint("merge"), ["src", "dst"], "left").select("src", "dst", F.coalesce("cost", F.lit(math.inf)).alias("cost"))
        shared, limit = self._adjacency(), math.inf if cutoff is None else float(cutoff)
        to = self.spark.sparkContext.broadcast(np.sort(z))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, dst = shared.value[0], to.value
            own = _places(ids, dst)
            for b in batches:
                s = b.column(0).to_numpy()
                at = _places(ids, s)
                known = at < len(ids)
                for x in s[~known]:
                    yield from _batches(x, dst, np.full(len(dst), math.inf))
                for x, (found, cost) in zip(s[known], _each(shared, at[known], limit), strict=True):
                    row = np.full(len(ids) + 1, math.inf)
                    row[found] = cost
                    yield from _batches(x, dst, row[own])

        return src.repartition(4 * self.partitions, "src").mapInArrow(run, "src long, dst long, cost double")

    def _rounds(self, sources: DataFrame, cutoff: float | None) -> DataFrame:
        tmp = Scratch(self.spark)
        adj = self.network.adjacency.select(F.col("src").alias("_u"), F.col("dst").alias("_v"), F.col("cost").alias("_c"))
        known = self.network.nodes.select(F.col("node_id").alias("src"))
        state = tmp.put(sources.select(F.col("src").cast("long")).distinct().join(known, "src", "left_semi").select("src", F.col("src").alias("dst"), F.lit(0.0).alias("cost")), "s0")
        top = self.network.edges.agg(F.max("cost")).first()[0] or 0.0
        frontier, k, bound, done, drops = state, 0, -math.inf, [], []
        while (least := frontier.agg(F.min("cost")).first()[0]) is not None:
            k += 1
            if least - top > bound:
                # no new entry borders on these; of the others some lie below the last bound no more than these do
                bound = least - top
                done.append(tmp.put(state.where(F.col("cost") < bound), f"done{k}"))
                state = state.where(F.col("cost") >= bound)
            step = frontier.join(adj, F.col("dst") == F.col("_u")).select("src", F.col("_v").alias("dst"), (F.col("cost") + F.col("_c")).alias("cost"))
            if cutoff is not None:
                step = step.where(F.col("cost") <= float(cutoff))
            step = step.groupBy("src", "dst").agg(F.min("cost").alias("cost"))
            # 0 marks what was known before, 1 what this round found
            both = state.withColumn("new", F.lit(0)).unionByName(step.withColumn("new", F.lit(1)))
            best = tmp.put(both.groupBy("src", "dst").agg(F.min(F.struct("cost", "new")).alias("b")).select("src", "dst", "b.cost", "b.new"), f"s{k}")
            if drops:
                tmp.drop(*drops, free=False)
            drops = [f"s{k - 1}"]
            state, frontier = best.drop("new"), best.where("new = 1").drop("new")
        return reduce(DataFrame.unionByName, done, state)
