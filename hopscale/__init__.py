"""hopscale: multi-resolution travel cost and accessibility on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from hopscale.functions.decay import exponential_interaction, power_law_interaction  # noqa: E402
from hopscale.network import Network  # noqa: E402
from hopscale.operators.dense import compute_dense_cost_matrix, compute_dense_interaction_matrix  # noqa: E402
from hopscale.operators.hierarchy import Hierarchy  # noqa: E402
from hopscale.operators.interaction import InteractionHierarchy  # noqa: E402
from hopscale.sources.generators import (  # noqa: E402
    generate_grid_network,
    generate_large_spatial_network,
    generate_random_spatial_network,
    generate_transport_network,
)
from hopscale.sources.storage import StorageError, export_npz, import_npz, import_npz_interaction, load_hierarchy, load_interaction, save_hierarchy, save_interaction  # noqa: E402

__version__ = "0.1.0"
#: Optional single-node packages are never used.
HAS_GRAPH_TOOL = False
HAS_H5PY = False

__all__ = [
    "HAS_GRAPH_TOOL",
    "HAS_H5PY",
    "Hierarchy",
    "InteractionHierarchy",
    "Network",
    "StorageError",
    "compute_dense_cost_matrix",
    "compute_dense_interaction_matrix",
    "exponential_interaction",
    "export_npz",
    "generate_grid_network",
    "generate_large_spatial_network",
    "generate_random_spatial_network",
    "generate_transport_network",
    "import_npz",
    "import_npz_interaction",
    "load_hierarchy",
    "load_interaction",
    "power_law_interaction",
    "save_hierarchy",
    "save_interaction",
]
