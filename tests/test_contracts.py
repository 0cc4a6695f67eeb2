"""Arguments and inputs that must be refused, with the same exception classes and words."""

import pytest

import hopscale as H

PATH = [(0, 1, 10.0), (1, 2, 15.0), (2, 3, 20.0)]


@pytest.fixture(scope="module")
def toy(spark):
    return H.Network(spark.createDataFrame(PATH, "src long, dst long, cost double"))


@pytest.fixture(scope="module")
def built(toy):
    return H.Hierarchy(toy, base_radius=20)


@pytest.mark.parametrize(
    ("options", "error", "words"),
    [
        ({"base_radius": 0}, ValueError, "base_radius"),
        ({"base_radius": "x"}, ValueError, "base_radius"),
        ({"increase_factor": 1}, ValueError, "increase_factor"),
        ({"overlap_factor": 0}, ValueError, "overlap_factor"),
        ({"n_workers": 0}, ValueError, "n_workers"),
        ({"n_workers": 1.5}, ValueError, "n_workers"),
        ({"min_representatives": 1}, ValueError, "min_representatives"),
        ({"zones": []}, ValueError, "non-empty"),
        ({"zones": [0, 99]}, ValueError, "not in network"),
        ({"zones": ["a"]}, TypeError, "integers"),
        ({"backend": "abacus"}, ValueError, "Unknown backend"),
    ],
)
def test_hierarchy_arguments(toy, options, error, words):
    with pytest.raises(error, match=words):
        H.Hierarchy(toy, **({"base_radius": 20} | options))


def test_network_must_be_one():
    with pytest.raises(TypeError, match="undirected simple"):
        H.Hierarchy([(0, 1)])


@pytest.mark.parametrize(
    ("rows", "schema", "error", "words"),
    [
        ([], "src long, dst long, cost double", ValueError, "empty"),
        ([(0, 1, None)], "src long, dst long, cost double", ValueError, "missing a 'cost'"),
        ([(0, 1)], "src long, dst long", ValueError, "missing a 'cost'"),
        ([(0, 1, float("nan"))], "src long, dst long, cost double", ValueError, "invalid cost"),
        ([(0, 1, float("inf"))], "src long, dst long, cost double", ValueError, "invalid cost"),
        ([(0, 1, -1.0)], "src long, dst long, cost double", ValueError, "invalid cost"),
        ([(0, 1, "x")], "src long, dst long, cost string", ValueError, "invalid cost"),
        ([("a", "b", 1.0)], "src string, dst string, cost double", TypeError, "integers"),
        ([(None, 1, 1.0)], "src long, dst long, cost double", TypeError, "integers"),
        ([(0, 1, 1.0), (1, 0, 2.0)], "src long, dst long, cost double", TypeError, "undirected simple"),
    ],
)
def test_network_inputs(spark, rows, schema, error, words):
    with pytest.raises(error, match=words):
        H.Network(spark.createDataFrame(rows, schema))


def test_unknown_zones(built):
    with pytest.raises(ValueError, match="source_zone"):
        built.get_cost(99, 0)
    with pytest.raises(ValueError, match="dest_zone"):
        built.get_cost(0, 99)


def test_operator_arguments(built):
    ih = H.InteractionHierarchy(built, "1 / (cost + 5)")
    with pytest.raises(ValueError, match="dimension mismatch"):
        ih.matvec([1.0, 2.0])
    with pytest.raises(ValueError, match="source_zone"):
        ih.get_row(99)
    assert ih.shape == (4, 4) and ih.dtype == "float64"


@pytest.mark.parametrize(
    ("make", "words"),
    [
        (lambda s: H.generate_grid_network(s, 0, 3), "n_x"),
        (lambda s: H.generate_grid_network(s, 3, 0), "n_y"),
        (lambda s: H.generate_grid_network(s, 3, 3, 0), "spacing"),
        (lambda s: H.generate_random_spatial_network(s, 0), "n_zones"),
        (lambda s: H.generate_random_spatial_network(s, 5, area_size=0), "area_size"),
        (lambda s: H.generate_random_spatial_network(s, 5, connection_radius=0), "connection_radius"),
        (lambda s: H.generate_large_spatial_network(s, 0), "n_zones"),
        (lambda s: H.generate_transport_network(s, 2), "n_zones"),
        (lambda s: H.exponential_interaction(1.0, -1), "non-negative"),
    ],
)
def test_generator_arguments(spark, make, words):
    with pytest.raises(ValueError, match=words):
        make(spark)
