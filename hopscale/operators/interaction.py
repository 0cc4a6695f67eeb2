"""Interaction as a corrected sparse operator over the layers of a hierarchy.

H = sum over layers of G' (D - Corr) G. One table holds all layers: interactions (layer, src, dst,
value, correction, net). A product with an activity is one plan of three grouped sums over all layers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.functions.decay import as_column
from hopscale.operators.hierarchy import Hierarchy


class InteractionHierarchy:
    """interaction_fn: Column -> Column (stays in the JVM), a SQL expression in `cost`, or a Python function of one number.

    exact_zero: correct with the first coarser entry that is stored, even if its value is 0. By default
    entries of value 0 are passed over, so with functions that reach 0 the result is not f(cost) everywhere.
    """

    dtype = np.dtype(np.float64)

    def __init__(self, hierarchy: Hierarchy, interaction_fn: Callable | str, self_interaction: bool = True, *, exact_zero: bool = False):
        self.hierarchy, self.interaction_fn, self.self_interaction = hierarchy, interaction_fn, self_interaction
        self.spark, self._tmp = hierarchy.spark, hierarchy._tmp
        value = as_column(interaction_fn, F.col("cost"))
        d = hierarchy.costs.select("layer", "src", "dst", value.cast("double").alias("value"))
        if not self_interaction:
            d = d.where(~((F.col("layer") == 0) & ((F.col("src") == F.col("dst")) | (F.col("value") == 0))))
        self.interactions = self._corrected(self._tmp.put(d, f"values{id(self)}"), exact_zero)
        self.shape = (hierarchy.n_zones, hierarchy.n_zones)

    def _corrected(self, d: DataFrame, exact_zero: bool) -> DataFrame:
        full = self.hierarchy.first_match(d, d if exact_zero else d.where("value > 0"))
        full = full.select("layer", "src", "dst", "value", F.col("found").alias("correction"), (F.col("value") - F.coalesce("found", F.lit(0.0))).alias("net"))
        return self._tmp.put(full, f"interactions{id(self)}")

    @classmethod
    def from_tables(cls, hierarchy: Hierarchy, interactions: DataFrame, interaction_fn=None, self_interaction: bool = True) -> InteractionHierarchy:
        ih = cls.__new__(cls)
        ih.hierarchy, ih.interaction_fn, ih.self_interaction = hierarchy, interaction_fn, self_interaction
        ih.spark, ih._tmp, ih.interactions = hierarchy.spark, hierarchy._tmp, interactions
        ih.shape = (hierarchy.n_zones, hierarchy.n_zones)
        return ih

    @cached_property
    def _zone_list(self) -> list[int]:
        """Zones in order; only the array interface, whose vectors live on the driver anyway, needs it."""
        return [r.zone for r in self.hierarchy.zones.orderBy("zone").collect()]

    def apply(self, activity: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """activity (zone, value, *by) -> accessibility (zone, value, *by) of every zone, for each combination of `by`.

        Several rows of a zone add up; nulls count as nothing; zones without interaction get 0.
        """
        h, by = self.hierarchy, list(by)
        rolled = h.groups.join(activity.select("zone", "value", *by), "zone").groupBy("layer", F.col("rep").alias("dst"), *by).agg(F.sum("value").alias("v"))
        part = self.interactions.where("net <> 0").select("layer", "src", "dst", "net").join(rolled, ["layer", "dst"]).groupBy("layer", F.col("src").alias("rep"), *by).agg(F.sum(F.col("net") * F.col("v")).alias("c"))
        got = h.groups.join(part, ["layer", "rep"]).groupBy("zone", *by).agg(F.sum("c").alias("value"))
        every = h.zones.select("zone")
        if by:
            every = every.crossJoin(activity.select(*by).distinct())  # zones times right-hand sides: the result's own size
        return every.join(got, ["zone", *by], "left").select("zone", *by, F.coalesce("value", F.lit(0.0)).alias("value"))

    def matvec(self, activity):
        """Accessibility of every zone: DataFrame in, DataFrame out; a vector in the order of the zones gives a vector."""
        if isinstance(activity, DataFrame):
            return self.apply(activity)
        a = np.asarray(activity, np.float64)
        if a.shape not in ((self.shape[1],), (self.shape[1], 1)):
            raise ValueError(f"dimension mismatch: the operator has shape {self.shape}, the vector {a.shape}")
        df = self.spark.createDataFrame(list(zip(self._zone_list, a.ravel().tolist(), strict=True)), "zone long, value double")
        out = {r.zone: r.value for r in self.apply(df).collect()}
        return np.array([out[z] for z in self._zone_list]).reshape(a.shape)

    def rmatvec(self, activity):
        """The operator is symmetric."""
        return self.matvec(activity)

    def matmat(self, activities):
        """Several activities at once: (zone, rhs, value), or a matrix with one column for each."""
        if isinstance(activities, DataFrame):
            return self.apply(activities, ("rhs",))
        x = np.asarray(activities, np.float64)
        if x.ndim != 2 or x.shape[0] != self.shape[1]:
            raise ValueError(f"dimension mismatch: the operator has shape {self.shape}, the matrix {x.shape}")
        rows = [(z, k, float(v)) for z, row in zip(self._zone_list, x, strict=True) for k, v in enumerate(row)]
        at = {z: i for i, z in enumerate(self._zone_list)}
        out = np.zeros(x.shape)
        for r in self.apply(self.spark.createDataFrame(rows, "zone long, rhs int, value double"), ("rhs",)).collect():
            out[at[r.zone], r.rhs] = r.value
        return out

    def __matmul__(self, x):
        return self.matvec(x) if isinstance(x, DataFrame) or np.ndim(x) == 1 else self.matmat(x)

    def row(self, source_zone: int) -> DataFrame:
        """(zone, value): the interaction of one zone with every zone."""
        if not self.hierarchy.zones.where(F.col("zone") == F.lit(source_zone)).take(1):
            raise ValueError(f"source_zone {source_zone!r} is not a zone of the hierarchy")
        return self.apply(self.spark.createDataFrame([(source_zone, 1.0)], "zone long, value double"))

    def get_row(self, source_zone: int) -> np.ndarray:
        out = {r.zone: r.value for r in self.row(source_zone).collect()}
        return np.array([out[z] for z in self._zone_list])

    def get_density(self) -> float:
        """Stored interactions over the squared number of zones; explicit zeros count."""
        return self.interactions.count() / self.hierarchy.n_zones**2

    def layer_info(self) -> DataFrame:
        """(layer, radius, n_representatives, n_interactions, n_corrections)."""
        r = self.hierarchy.reps.groupBy("layer").agg(F.count("*").alias("n_representatives"))
        i = self.interactions.groupBy("layer").agg(F.count("*").alias("n_interactions"), F.count("correction").alias("n_corrections"))
        return self.hierarchy.layers.join(r, "layer").join(i, "layer", "left").select("layer", "radius", "n_representatives", F.coalesce("n_interactions", F.lit(0)).alias("n_interactions"), F.coalesce("n_corrections", F.lit(0)).alias("n_corrections"))

    def get_layer_info(self) -> list[dict]:
        return [{k: r[k] for k in ("radius", "n_representatives", "n_interactions", "n_corrections")} for r in self.layer_info().orderBy("layer").collect()]

    def save(self, path: str, *, include_network: bool = False, backend: str = "auto", interaction_fn_hint: str = "") -> str:
        from hopscale.sources.storage import save_interaction

        return save_interaction(self, path, include_network=include_network, backend=backend, interaction_fn_hint=interaction_fn_hint)

    @classmethod
    def load(cls, spark, path: str, *, interaction_fn=None, network=None) -> InteractionHierarchy:
        from hopscale.sources.storage import load_interaction

        return load_interaction(spark, path, interaction_fn=interaction_fn, network=network)
