"""Hierarchies as folders of Parquet tables.

One folder for each table, `costs`, `groups` and `interactions` partitioned by layer so that a reader of
one layer reads nothing else, rows sorted by source and destination inside a file. `metadata` has one
row. The interaction function is not stored, only a hint. Backend `npz` writes a single file of driver
size instead; loaders tell the two apart by what they find.
"""

from __future__ import annotations

import os
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale import schemas
from hopscale.network import Network
from hopscale.operators.hierarchy import Hierarchy
from hopscale.operators.interaction import InteractionHierarchy

FORMAT_VERSION = 1
BACKENDS = ("auto", "parquet", "npz")


class StorageError(Exception):
    """A folder that is no stored object of this engine, or one of another kind or version."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write(df: DataFrame, path: str, by_layer: bool = False) -> None:
    if by_layer:
        keys = [c for c in ("layer", "src", "dst", "zone") if c in df.columns]
        df.repartition("layer", keys[1]).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("layer").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def _save(h: Hierarchy, path: str, kind: str, include_network: bool, backend: str, more: dict) -> str:
    if backend not in BACKENDS:
        raise ValueError(f"Unknown storage backend {backend!r}; choose from {', '.join(BACKENDS)}")
    path = str(path).rstrip("/")
    for name in ("layers", "zones", "reps"):
        _write(getattr(h, name), f"{path}/{name}")
    _write(h.groups, f"{path}/groups", True)
    _write(h.costs, f"{path}/costs", True)
    if h.network is not None:
        place = h.network.nodes.where("x is not null and y is not null").select(F.col("node_id").alias("zone"), "x", "y")
        _write(h.zones.select("zone").join(place, "zone"), f"{path}/zone_coords")
        if include_network:
            _write(h.network.nodes, f"{path}/nodes")
            _write(h.network.edges, f"{path}/edges")
    meta = {"format_version": FORMAT_VERSION, "object_type": kind, "base_radius": float(h.base_radius), "increase_factor": float(h.increase_factor), "overlap_factor": float(h.overlap_factor), "min_representatives": h.min_representatives, "sp_backend": h.backend, "has_network": include_network and h.network is not None, "interaction_fn_hint": "", "self_interaction": True} | more
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    _write(h.spark.createDataFrame([tuple(meta.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in meta.items())), f"{path}/metadata")
    return path


def save_hierarchy(hierarchy: Hierarchy, path: str, *, include_network: bool = False, backend: str = "auto") -> str:
    if backend == "npz":
        return export_npz(hierarchy, path, include_network=include_network)
    return _save(hierarchy, path, "Hierarchy", include_network, backend, {})


def save_interaction(ih: InteractionHierarchy, path: str, *, include_network: bool = False, backend: str = "auto", interaction_fn_hint: str = "") -> str:
    if backend == "npz":
        return export_npz(ih, path, include_network=include_network, interaction_fn_hint=interaction_fn_hint)
    out = _save(ih.hierarchy, path, "InteractionHierarchy", include_network, backend, {"interaction_fn_hint": interaction_fn_hint, "self_interaction": ih.self_interaction})
    _write(ih.interactions, f"{out}/interactions", True)
    return out


def is_single_file(path: str) -> bool:
    """Whether a local path is a file that begins like an archive; another file is no stored object."""
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        magic = f.read(8)
    if magic[1:4] == b"HDF":
        raise StorageError(f"{path} is an HDF5 file, which this engine does not read; convert it to npz")
    if not magic.startswith(b"PK"):
        raise StorageError(f"{path} holds no stored hierarchy")
    return True


def read_metadata(spark: SparkSession, path: str) -> dict:
    path = str(path).rstrip("/")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if not _exists(spark, f"{path}/metadata"):
        raise StorageError(f"{path} holds no stored hierarchy")
    meta = spark.read.parquet(f"{path}/metadata").first().asDict()
    if meta.get("format_version", 0) > FORMAT_VERSION:
        raise StorageError(f"{path} has format version {meta['format_version']}; this version reads up to {FORMAT_VERSION}")
    return meta


def _load(spark: SparkSession, path: str, meta: dict, network: Network | None) -> Hierarchy:
    path = str(path).rstrip("/")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").select(*[c.split()[0] for c in schema.split(", ")])
    if network is None and meta["has_network"]:
        network = Network(read("edges", schemas.EDGES), read("nodes", schemas.NODES))
    tables = {n: read(n, s) for n, s in (("layers", schemas.LAYERS), ("zones", schemas.ZONES), ("reps", schemas.REPS), ("groups", schemas.GROUPS), ("costs", schemas.COSTS))}
    return Hierarchy.from_tables(**tables, params=meta, network=network)


def load_hierarchy(spark: SparkSession, path: str, *, network: Network | None = None) -> Hierarchy:
    """The hierarchy stored there, as a folder or a single file, also from a stored interaction."""
    if is_single_file(path):
        return import_npz(spark, path, network=network)
    return _load(spark, path, read_metadata(spark, path), network)


def load_interaction(spark: SparkSession, path: str, *, interaction_fn=None, network: Network | None = None) -> InteractionHierarchy:
    """The interaction stored there, as a folder or a single file; the function is only needed to build another one."""
    if is_single_file(path):
        return import_npz_interaction(spark, path, interaction_fn=interaction_fn, network=network)
    meta = read_metadata(spark, path)
    if meta["object_type"] != "InteractionHierarchy":
        raise StorageError(f"{path} holds a {meta['object_type']}, not an InteractionHierarchy")
    stored = spark.read.schema(schemas.INTERACTIONS).parquet(f"{str(path).rstrip('/')}/interactions").select(*[c.split()[0] for c in schemas.INTERACTIONS.split(", ")])
    return InteractionHierarchy.from_tables(_load(spark, path, meta, network), stored, interaction_fn, meta["self_interaction"])


#: Fixed names of the arrays in the single-file exchange format, by table and column.
NPZ_ARRAYS = {
    "reps": {"layer": "repr_layer_idx", "zone": "repr_zone"},
    "groups": {"layer": "groups_layer_idx", "zone": "groups_zone", "rep": "groups_rep"},
    "costs": {"layer": "costs_layer_idx", "src": "costs_src", "dst": "costs_dst", "cost": "costs_val"},
}
NPZ_PARAMS = ("base_radius", "increase_factor", "overlap_factor", "min_representatives")
#: Fixed names of an interaction's matrices there, compressed by rows: of layer k the arrays D_0_data, D_0_indices, D_0_indptr, D_0_shape and so on.
NPZ_MATRICES = {"value": "D", "correction": "corr"}
#: Rows of all tables that a single file, made in the driver's memory, may have.
MAX_EXCHANGED = 50_000_000


def _column(df: DataFrame, c: str) -> np.ndarray:
    return df.select(c).toArrow().column(0).to_numpy()


def _compressed(src: np.ndarray, dst: np.ndarray, value: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """A sparse square matrix by rows, from indices."""
    order = np.lexsort((dst, src))
    return {"data": value[order], "indices": dst[order].astype(np.int32), "indptr": np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))).astype(np.int32), "shape": np.array([n, n])}


def export_npz(h: Hierarchy | InteractionHierarchy, path: str, *, include_network: bool = False, interaction_fn_hint: str = "") -> str:
    """A hierarchy or an interaction of driver size as one compressed file of columns; the suffix is added if missing."""
    path = path if str(path).endswith(".npz") else f"{path}.npz"
    ih, h = (h, h.hierarchy) if isinstance(h, InteractionHierarchy) else (None, h)
    rows = sum(getattr(h, name).count() for name in NPZ_ARRAYS) + (ih.interactions.count() if ih else 0)
    if rows > MAX_EXCHANGED:
        raise StorageError(f"{rows} rows are too many for a single file, which takes up to {MAX_EXCHANGED}; store a folder")
    arrays = {"radii": np.array(h.radii, np.float64), "cutoffs": np.array([np.nan if c is None else c for c in h.cutoffs]), "zones": np.sort(_column(h.zones, "zone"))}
    for name, names in NPZ_ARRAYS.items():
        t = getattr(h, name).orderBy(*list(names)[:3]).select(*names).toArrow()
        arrays |= {to: t.column(c).to_numpy() for c, to in names.items()}
    meta = {k: getattr(h, k) for k in NPZ_PARAMS} | {"format_version": FORMAT_VERSION, "object_type": "Hierarchy", "sp_backend": h.backend, "backend": "npz"}
    if h.network is not None:
        at = h.network.nodes.where("x is not null and y is not null").join(h.zones.select(F.col("zone").alias("node_id")), "node_id").orderBy("node_id").toArrow()
        if at.num_rows == h.n_zones:
            arrays |= {"zone_x": at.column("x").to_numpy(), "zone_y": at.column("y").to_numpy()}
        if include_network:
            e = h.network.edges.toArrow()
            arrays |= {f"net_edge_{c}": e.column(c).to_numpy() for c in ("src", "dst", "cost")} | {"net_nodes": np.sort(_column(h.network.nodes, "node_id"))}
    if ih is not None:
        arrays["n_layers"] = np.array(len(h.radii))
        t = ih.interactions.toArrow()
        layer, src, dst = (t.column(c).to_numpy() for c in ("layer", "src", "dst"))
        for k in range(len(h.radii)):
            zones = arrays["repr_zone"][arrays["repr_layer_idx"] == k]
            for c, name in NPZ_MATRICES.items():
                v = t.column(c).to_numpy(zero_copy_only=False)
                own = (layer == k) & ~np.isnan(v)
                arrays |= {f"{name}_{k}_{x}": y for x, y in _compressed(np.searchsorted(zones, src[own]), np.searchsorted(zones, dst[own]), v[own], len(zones)).items()}
        meta |= {"object_type": "InteractionHierarchy", "self_interaction": int(ih.self_interaction), "interaction_fn_hint": interaction_fn_hint}
    np.savez_compressed(path, **arrays, **{f"_meta_{k}": np.array(v) for k, v in meta.items()})
    return path


def import_npz(spark: SparkSession, path: str, *, network: Network | None = None) -> Hierarchy:
    """A hierarchy from such a file, also from one that a single-node library wrote, with its network if it holds one; of an interaction its hierarchy."""
    return _from_npz(spark, path, network)[0]


def import_npz_interaction(spark: SparkSession, path: str, *, interaction_fn=None, network: Network | None = None) -> InteractionHierarchy:
    """An interaction from such a file; the function is only needed to build another one."""
    h, stored, meta = _from_npz(spark, path, network)
    if stored is None:
        raise StorageError(f"{path} holds a {meta['object_type']}, not an InteractionHierarchy")
    return InteractionHierarchy.from_tables(h, stored, interaction_fn, bool(meta["self_interaction"]))


def _from_npz(spark: SparkSession, path: str, network: Network | None) -> tuple[Hierarchy, DataFrame | None, dict]:
    try:
        f = np.load(path, allow_pickle=False)
    except (ValueError, zipfile.BadZipFile) as e:
        raise StorageError(f"{path} holds no stored hierarchy: {e}") from e
    with f:
        if "radii" not in f or "_meta_object_type" not in f:
            raise StorageError(f"{path} holds no stored hierarchy")
        meta = {k.removeprefix("_meta_"): f[k].item() for k in f.files if k.startswith("_meta_")}
        if meta["format_version"] > FORMAT_VERSION:
            raise StorageError(f"{path} has format version {meta['format_version']}; this version reads up to {FORMAT_VERSION}")

        def table(schema: str, *columns) -> DataFrame:
            names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
            kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            return spark.createDataFrame(pa.table({n: pa.array(c, kinds[t], from_pandas=True) for n, t, c in zip(names, types, columns, strict=True)}))

        cutoffs = [None if np.isnan(c) else float(c) for c in f["cutoffs"]]
        zones = np.sort(f["zones"])
        layer, zone = f["repr_layer_idx"], f["repr_zone"]
        order = np.lexsort((zone, layer))
        layer, zone = layer[order], zone[order]
        tables = {
            "layers": table(schemas.LAYERS, np.arange(len(cutoffs)), f["radii"].astype(float), cutoffs),
            "zones": table(schemas.ZONES, zones, np.arange(len(zones))),
            "reps": table(schemas.REPS, layer, zone, np.arange(len(zone)) - np.searchsorted(layer, layer)),
            "groups": table(schemas.GROUPS, *(f[a] for a in NPZ_ARRAYS["groups"].values())),
            "costs": table(schemas.COSTS, *(f[a] for a in NPZ_ARRAYS["costs"].values())),
        }
        if network is None and "net_edge_src" in f:
            network = Network(table(schemas.EDGES, *(f[f"net_edge_{c}"] for c in ("src", "dst", "cost"))), table("node_id long", f["net_nodes"]))
        h = Hierarchy.from_tables(**tables, params={k: meta[k] for k in (*NPZ_PARAMS, "sp_backend")}, network=network)
        if meta["object_type"] != "InteractionHierarchy":
            return h, None, meta
        parts = []
        for k in range(len(cutoffs)):
            own = zone[layer == k]
            cells = {}
            for c, name in NPZ_MATRICES.items():
                if f"{name}_{k}_data" in f:
                    at = np.repeat(np.arange(len(own)), np.diff(f[f"{name}_{k}_indptr"]))
                    cells[c] = (at * len(own) + f[f"{name}_{k}_indices"], f[f"{name}_{k}_data"])
            key, value = cells["value"]
            corr = np.full(len(key), np.nan)
            if "correction" in cells and len(cells["correction"][0]):
                order = np.argsort(cells["correction"][0])
                there, v = cells["correction"][0][order], cells["correction"][1][order]
                j = np.minimum(np.searchsorted(there, key), len(there) - 1)
                corr = np.where(there[j] == key, v[j], np.nan)
            parts.append((np.full(len(key), k), own[key // max(1, len(own))], own[key % max(1, len(own))], value, corr, value - np.nan_to_num(corr)))
        return h, table(schemas.INTERACTIONS, *(np.concatenate(c) for c in zip(*parts, strict=True))), meta
