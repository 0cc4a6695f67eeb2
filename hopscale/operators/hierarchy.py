"""The hierarchy: layers of representatives, the costs stored between them, and the zones' groups.

Tables: layers (layer, radius, cutoff), reps (layer, zone, rep_idx), costs (layer, src, dst, cost),
groups (layer, zone, rep). Layers are keyed by number; the driver only loops over layers (their number
grows with the logarithm of the extent) and reads counts. Each table is written once as Parquet, so
lineage stays flat and every later join knows its sizes.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce
from numbers import Integral, Real

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hopscale.network import Network
from hopscale.operators.ranking import ranked
from hopscale.operators.representatives import assign, first_independent_set, scan
from hopscale.operators.sssp import MAX_BROADCAST_EDGES, ShortestPaths, pick_strategy
from hopscale.scratch import SMALL_BYTES, Scratch, small


#: Most zones whose ids the driver keeps while it builds.
DRIVER_ZONES = 100_000


def _number(x) -> bool:
    """Python's and numpy's numbers, but no truth values."""
    return isinstance(x, Real) and not isinstance(x, bool) and math.isfinite(x)


def _whole(x) -> bool:
    return isinstance(x, Integral) and not isinstance(x, bool)


def extent(paths: ShortestPaths, zones: DataFrame, n_zones: int) -> float:
    """The largest cost from some ten zones, taken at equal steps, to any node. zones (zone, zone_idx?)."""
    step = max(1, n_zones // min(10, n_zones))
    if "zone_idx" not in zones.columns:
        zones = ranked(Scratch(zones.sparkSession), zones, ["zone"], "zone_ranges").withColumnRenamed("rank", "zone_idx")
    some = zones.where(F.col("zone_idx") % step == 0).select(F.col("zone").alias("src"))
    return paths.search(some).agg(F.max("cost")).first()[0] or 0.0


def violations(groups: DataFrame) -> DataFrame:
    """groups (layer, zone, rep) -> (layer, rep, coarse_layer, n): groups of a layer that a coarser layer splits into n."""
    fine = groups.select("layer", "zone", "rep")
    coarse = groups.select(F.col("layer").alias("coarse_layer"), "zone", F.col("rep").alias("coarse_rep"))
    both = fine.join(coarse, "zone").where("coarse_layer > layer")
    return both.groupBy("layer", "rep", "coarse_layer").agg(F.count_distinct("coarse_rep").alias("n")).where("n > 1")


class Hierarchy:
    """Build with a network, or from stored tables with `from_tables`.

    n_workers is a hint for the number of partitions of a search (times the default parallelism).
    """

    def __init__(self, network: Network, base_radius: float = 5000, increase_factor: float = 2, overlap_factor: float = 1.5, zones: list[int] | DataFrame | None = None, backend: str = "auto", n_workers: int = 1, min_representatives: int = 3):
        if not isinstance(network, Network):
            raise TypeError(f"the network must be an undirected simple graph given as a Network, got {type(network).__name__}")
        if not _number(base_radius) or base_radius <= 0:
            raise ValueError(f"base_radius must be a positive number, got {base_radius!r}")
        if not _number(increase_factor) or increase_factor <= 1:
            raise ValueError(f"increase_factor must be greater than 1, got {increase_factor!r}")
        if not _number(overlap_factor) or overlap_factor <= 0:
            raise ValueError(f"overlap_factor must be positive, got {overlap_factor!r}")
        if not _whole(n_workers) or n_workers < 1:
            raise ValueError(f"n_workers must be an integer of at least 1, got {n_workers!r}")
        if not _whole(min_representatives) or min_representatives < 2:
            raise ValueError(f"min_representatives must be an integer of at least 2, got {min_representatives!r}")
        pick_strategy(backend, max(network.n_edges, network.n_nodes))
        self.network, self.spark = network, network.spark
        self.base_radius, self.increase_factor, self.overlap_factor = base_radius, increase_factor, overlap_factor
        self.n_workers, self.min_representatives, self.backend = n_workers, min_representatives, backend
        self._tmp = Scratch(self.spark)
        self.zones, self.n_zones = self._take_zones(zones)
        parts = None if n_workers == 1 else n_workers * self.spark.sparkContext.defaultParallelism
        self._paths = ShortestPaths(network, backend, parts)
        self.total_nodes_explored = 0
        self._build()

    def _take_zones(self, zones) -> tuple[DataFrame, int]:
        nodes = self.network.nodes.select(F.col("node_id").alias("zone"))
        if zones is None:
            z = nodes
        elif isinstance(zones, DataFrame):
            z = zones.select("zone").distinct()
            if not isinstance(z.schema["zone"].dataType, IntegralType):
                raise TypeError("zone ids must be integers")
        elif isinstance(zones, (list, tuple, set, np.ndarray)) and len(zones):
            if not all(_whole(x) for x in zones):
                raise TypeError("zone ids must be integers")
            z = self.spark.createDataFrame([(x,) for x in sorted({int(x) for x in zones})], "zone long")
        else:
            raise ValueError("zones must be a non-empty list, set or DataFrame")
        z = z.select(F.col("zone").cast("long").alias("zone"))
        if zones is not None:
            foreign = [r.zone for r in z.join(nodes, "zone", "left_anti").limit(5).collect()]
            if foreign:
                raise ValueError(f"zones not in network: {foreign}")
        z = self._tmp.put(ranked(self._tmp, z, ["zone"], "zone_ranges").select("zone", F.col("rank").cast("int").alias("zone_idx")), "zones")
        n = z.count()
        if not n:
            raise ValueError("zones must be a non-empty set of nodes")
        return z, n

    # -- build -----------------------------------------------------------------------------------

    def _radii(self) -> list[float]:
        reach = 1.5 * (extent(self._paths, self.zones, self.n_zones) or 10.0 * self.base_radius)
        out: list[float] = []
        while (r := float(self.base_radius) * float(self.increase_factor) ** len(out)) < reach or len(out) < 2:
            out.append(r)
        return out

    def _costs_between(self, reps: DataFrame, cutoff: float | None, name: str) -> DataFrame:
        """(src, dst, cost) between representatives within the cutoff, written; counts all nodes found on the way."""
        seen = Observation()
        found = self._paths.search(reps.select(F.col("zone").alias("src")), cutoff).observe(seen, F.count(F.lit(1)).alias("n"))
        out = self._tmp.put(found.join(reps.select(F.col("zone").alias("dst")), "dst", "left_semi").select("src", "dst", "cost"), name)
        self.total_nodes_explored += seen.get["n"]
        return out

    def _build(self) -> None:
        radii = self._radii()
        cutoffs: list[float | None] = [self.overlap_factor * r for r in radii[:-1]] + [None]
        reps = [self.zones.select("zone")]
        costs = [self._costs_between(reps[0], cutoffs[0], "costs0")]
        steps: list[DataFrame] = []
        left = self.n_zones
        # of few zones the driver keeps the representatives, which saves a table and several jobs a layer
        ids = [np.sort(self.zones.select("zone").toArrow().column(0).to_numpy())] if left <= DRIVER_ZONES else None
        for k in range(1, len(radii)):
            near = costs[-1].where((F.col("src") != F.col("dst")) & (F.col("cost") < radii[k] / 2))
            if ids is not None and (lost := scan(near.where("dst < src").select("src", "dst"))) is not None:
                ids.append(np.setdiff1d(ids[-1], lost, assume_unique=True))
                chosen, left = self.spark.createDataFrame(pa.table({"zone": ids[-1]})), len(ids[-1])
            else:
                ids = None
                chosen, n_lost = first_independent_set(self._tmp, reps[-1], near, f"layer{k}")
                left -= n_lost
            if k > 1 and left < self.min_representatives:
                radii, cutoffs = radii[:k], [*cutoffs[: k - 1], None]
                costs[-1] = self._costs_between(reps[-1], None, f"costs{k - 1}_all")
                break
            steps.append(assign(reps[-1], chosen, near))
            reps.append(chosen)
            costs.append(self._costs_between(chosen, cutoffs[k], f"costs{k}"))
        self.radii, self.cutoffs = radii, cutoffs
        self._set_layers()
        if ids is not None:
            ids = ids[: len(reps)]
            flat = {"layer": np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids]), "zone": np.concatenate(ids), "rep_idx": np.concatenate([np.arange(len(x), dtype=np.int32) for x in ids])}
            self.reps = self.spark.createDataFrame(pa.table(flat))
        else:
            self.reps = self._number(reps)
        # rep_k(z) = g_k(rep_{k-1}(z)): one row a zone, one join a layer, one plan
        chains = self.zones.select("zone", F.col("zone").alias("r0"))
        for k, g in enumerate(steps):
            chains = chains.join(g.select(F.col("zone").alias(f"r{k}"), F.col("rep").alias(f"r{k + 1}")), f"r{k}")
        self._chains = self._tmp.put(chains.select("zone", *[f"r{k}" for k in range(len(reps))]), "chains")
        every_rep = F.posexplode(F.array(*[f"r{k}" for k in range(len(reps))])).alias("layer", "rep")
        self.groups = self._tmp.put(self._chains.select("zone", every_rep).select("layer", "zone", "rep"), "groups")
        self.costs = self._fill_gaps(reduce(DataFrame.unionByName, [c.select(F.lit(k).alias("layer"), "src", "dst", "cost") for k, c in enumerate(costs)]))

    def _number(self, reps: list[DataFrame]) -> DataFrame:
        """(layer, zone, rep_idx) of all layers."""
        every = ranked(self._tmp, reduce(DataFrame.unionByName, [r.select(F.lit(k).alias("layer"), "zone") for k, r in enumerate(reps)]), ["layer", "zone"], "rep_ranges")
        first = every.groupBy("layer").agg(F.min("rank").alias("first"))
        return self._tmp.put(every.join(first, "layer").select("layer", "zone", (F.col("rank") - F.col("first")).cast("int").alias("rep_idx")), "reps")

    def _set_layers(self) -> None:
        rows = list(zip(range(len(self.radii)), self.radii, self.cutoffs, strict=True))
        self.layers = self.spark.createDataFrame(rows, "layer int, radius double, cutoff double")

    def _fill_gaps(self, costs: DataFrame) -> DataFrame:
        """costs and those of pairs of representatives of one layer that share a representative of the next."""
        up = self.groups.select((F.col("layer") - 1).alias("layer"), "zone", F.col("rep").alias("up"))
        member = self.reps.select("layer", "zone").join(up, ["layer", "zone"])
        pairs = member.withColumnRenamed("zone", "src").join(member.withColumnRenamed("zone", "dst"), ["layer", "up"]).where("src <> dst").select("layer", "src", "dst")
        missing = self._tmp.put(pairs.join(costs, ["layer", "src", "dst"], "left_anti"), "missing")
        found = [costs]
        for k in sorted(r.layer for r in missing.select("layer").distinct().collect()):
            own = missing.where(F.col("layer") == k)
            seen = Observation()
            reach = self._paths.search(own.select("src").distinct(), self.radii[k + 1]).observe(seen, F.count(F.lit(1)).alias("n"))
            found.append(self._tmp.put(reach.join(own, ["src", "dst"]).select("layer", "src", "dst", "cost"), f"filled{k}"))
            self.total_nodes_explored += seen.get["n"]
        return self._tmp.put(reduce(DataFrame.unionByName, found), "costs")

    @classmethod
    def from_tables(cls, *, layers: DataFrame, zones: DataFrame, reps: DataFrame, groups: DataFrame, costs: DataFrame, params: dict, network: Network | None = None) -> Hierarchy:
        """A hierarchy over stored tables; nothing is computed but the number of zones."""
        h = cls.__new__(cls)
        h.network, h.spark, h.zones, h.reps, h.groups, h.costs, h.layers = network, zones.sparkSession, zones, reps, groups, costs, layers
        h.base_radius, h.increase_factor, h.overlap_factor = (float(params[k]) for k in ("base_radius", "increase_factor", "overlap_factor"))
        h.min_representatives, h.backend, h.n_workers, h.total_nodes_explored = int(params["min_representatives"]), params["sp_backend"], 1, 0
        rows = layers.orderBy("layer").collect()
        h.radii, h.cutoffs = [r.radius for r in rows], [r.cutoff for r in rows]
        h.n_zones = zones.count()
        h._tmp = Scratch(h.spark)
        h._paths = ShortestPaths(network, h.backend) if network is not None else None
        return h

    # -- use -------------------------------------------------------------------------------------

    def get_costs(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) -> (src, dst, cost, layer): the cost at the finest layer that stores one; inf and null layer if none does. Extra columns are not carried.

        Pairs of nodes that are no zones have no cost. Repeated pairs stay repeated.
        """
        own = pairs.select("src", "dst", F.lit(-1).alias("layer"))
        hit = self.first_match(own, self.costs.withColumnRenamed("cost", "value"))
        return hit.select("src", "dst", F.coalesce("found", F.lit(float("inf"))).alias("cost"), F.col("at").alias("layer"))

    def get_all_costs(self, most: int = MAX_BROADCAST_EDGES) -> DataFrame:
        """(src, dst, cost, layer) of every ordered pair of zones, as get_costs gives them.

        A task makes all of a source's row: it has the costs that its representatives store, a few hundred, and
        every zone's representatives, which are broadcast for up to `most` zones. No pair is shuffled or joined.
        """
        if self.n_zones > most:
            z = self.zones.select(F.col("zone").alias("src"))
            return self.get_costs(z.crossJoin(z.withColumnRenamed("src", "dst")))  # the result's own size
        layers, chains = range(len(self.radii)), self._chains.toArrow().sort_by("zone")
        # of each layer the representatives in order, and every zone's place among them; -1 without one
        reps = []
        for k in layers:
            c = chains.column(f"r{k}")
            known = np.asarray(c.is_valid())
            ids, at = np.unique(c.drop_null().to_numpy(), return_inverse=True)
            place = np.full(len(known), -1, np.int32)
            place[known] = at
            reps.append((ids, place))
        shared = self.spark.sparkContext.broadcast((chains.column("zone").to_numpy(), reps))

        def rows(own: pa.Table) -> pa.Table:
            dst, of = shared.value
            cost, layer = np.full(len(dst), np.inf), np.full(len(dst), -1, np.int32)
            given = own.filter(own.column("dst").is_valid())
            at, to, value = (given.column(c).to_numpy() for c in ("layer", "dst", "cost"))
            for k in sorted(set(at.tolist()), reverse=True):  # finer ones over coarser ones
                ids, place = of[k]
                mine = at == k
                i = np.searchsorted(ids, to[mine])
                hit = ids[np.minimum(i, len(ids) - 1)] == to[mine]
                stored, has = np.empty(len(ids) + 1), np.zeros(len(ids) + 1, bool)  # the last is for place -1
                stored[i[hit]], has[i[hit]] = value[mine][hit], True
                found = np.flatnonzero(has[place])
                cost[found], layer[found] = stored[place[found]], k
            src = np.full(len(dst), own.column("zone")[0].as_py())
            return pa.table({"src": src, "dst": dst, "cost": cost, "layer": pa.array(layer, mask=layer < 0)})

        c = self.costs.select("layer", F.col("src").alias("rep"), "dst", "cost")
        stored = self.groups.select("layer", "zone", "rep").join(c, ["layer", "rep"], "left").select("zone", "layer", "dst", "cost")
        # a zone's costs are few beside its row, so the number of tasks follows the cores and not the bytes
        parts = 4 * self.spark.sparkContext.defaultParallelism
        return stored.repartition(parts, "zone").groupBy("zone").applyInArrow(rows, "src long, dst long, cost double, layer int")

    @cached_property
    def _chains(self) -> DataFrame:
        """(zone, r0, r1, ...): each zone's representatives of all layers, one row a zone."""
        each = [F.max(F.when(F.col("layer") == k, F.col("rep"))).alias(f"r{k}") for k in range(len(self.radii))]
        return self._tmp.put(self.groups.groupBy("zone").agg(*each), "chains")

    def first_match(self, pairs: DataFrame, stored: DataFrame) -> DataFrame:
        """pairs (src, dst, layer, ...) with `found` and `at`: the value that the first layer above `layer` stores for the pair's representatives, and that layer; null without one.

        stored (layer, src, dst, value) is one value for each pair. Layers are walked from fine to coarse
        and match only pairs without a hit. Coarse layers are counted to be small and broadcast, so the
        few keys they have are never shuffled on; fine ones have many keys.
        """
        layers = range(len(self.radii))
        names = pairs.columns
        # rows of five numbers at most; one count serves all layers
        sizes = {r.layer: r["count"] for r in stored.groupBy("layer").count().collect()}
        chains = small(self._chains)
        chain = lambda end: chains.select(F.col("zone").alias(f"_{end}"), *[F.col(f"r{k}").alias(f"_{end}{k}") for k in layers])
        r = pairs.join(chain("s"), F.col("src") == F.col("_s"), "left").join(chain("d"), F.col("dst") == F.col("_d"), "left")
        r = r.withColumns({"found": F.lit(None).cast("double"), "at": F.lit(None).cast("int")})
        for k in layers:
            c = stored.where(F.col("layer") == k).select(F.col("src").alias("_cs"), F.col("dst").alias("_cd"), F.col("value").alias("_v"))
            on = (F.col(f"_s{k}") == F.col("_cs")) & (F.col(f"_d{k}") == F.col("_cd")) & F.col("found").isNull() & (F.col("layer") < k)
            c = F.broadcast(c) if 56 * sizes.get(k, 0) <= SMALL_BYTES else c
            r = r.join(c, on, "left").withColumns({"at": F.when(F.col("found").isNull() & F.col("_v").isNotNull(), F.lit(k)).otherwise(F.col("at")), "found": F.coalesce("found", "_v")}).drop("_cs", "_cd", "_v")
        return r.select(*names, "found", "at")

    def get_cost(self, source_zone: int, dest_zone: int) -> float:
        """One pair; use get_costs for many."""
        given = {"source_zone": source_zone, "dest_zone": dest_zone}
        known = {r.zone for r in self.zones.where(F.col("zone").isin([int(z) for z in given.values() if _whole(z)])).select("zone").collect()}
        for name, z in given.items():
            if not _whole(z) or z not in known:
                raise ValueError(f"{name} {z!r} is not a zone of the hierarchy")
        return self.get_costs(self.spark.createDataFrame([(int(source_zone), int(dest_zone))], "src long, dst long")).first().cost

    def get_density(self) -> float:
        """Stored costs over the squared number of zones; can exceed 1."""
        return self.costs.count() / self.n_zones**2

    def get_finest_layer_density(self) -> float:
        return self.costs.where("layer = 0").count() / self.n_zones**2

    def layer_info(self) -> DataFrame:
        """(layer, radius, n_representatives, cutoff, n_costs)."""
        r = self.reps.groupBy("layer").agg(F.count("*").alias("n_representatives"))
        c = self.costs.groupBy("layer").agg(F.count("*").alias("n_costs"))
        return self.layers.join(r, "layer").join(c, "layer", "left").select("layer", "radius", "n_representatives", "cutoff", F.coalesce("n_costs", F.lit(0)).alias("n_costs"))

    def get_layer_info(self) -> list[dict]:
        return [{k: r[k] for k in ("radius", "n_representatives", "cutoff", "n_costs")} for r in self.layer_info().orderBy("layer").collect()]

    def nesting_violations(self) -> DataFrame:
        """(layer, rep, coarse_layer, n): groups of a layer that a coarser layer splits into n."""
        return violations(self.groups)

    def verify_group_nesting(self) -> tuple[bool, list[str]]:
        """Whether groups nest, and a sentence for each violation. For more than a driver can hold, read nesting_violations."""
        bad = self.nesting_violations().orderBy("layer", "rep", "coarse_layer").collect()
        return not bad, [f"Group nesting violation: group {r.rep} of layer {self.radii[r.layer]:.0f} is split into {r.n} groups at layer {self.radii[r.coarse_layer]:.0f}" for r in bad]

    def save(self, path: str, *, include_network: bool = False, backend: str = "auto") -> str:
        from hopscale.sources.storage import save_hierarchy

        return save_hierarchy(self, path, include_network=include_network, backend=backend)

    @classmethod
    def load(cls, spark, path: str, *, network: Network | None = None) -> Hierarchy:
        from hopscale.sources.storage import load_hierarchy

        return load_hierarchy(spark, path, network=network)
