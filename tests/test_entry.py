"""The driver's contract."""

import sys

import pytest

import __spark_entry__ as entry
from hopscale.plans.queries import ORACLES, QUERIES


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["zone", "value"] and df.count() == 10
    assert abs(df.agg({"value": "sum"}).first()[0] - 373.2456) < 1e-3


def test_registration():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and set(o) <= set(q) and set(ORACLES) <= set(o)


@pytest.mark.parametrize("name", ["layer_costs", "net_operator", "accessibility", "get_cost_pairs", "gap_fill_pairs"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("supplier", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = QUERIES[name](spark, d)
    want = c.execute(ORACLES[name]).fetchall()
    names = [x[0] for x in c.description]
    key = lambda r: tuple((x is not None, round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, map(tuple, df.select(*names).collect()))) == sorted(map(key, want))


@pytest.mark.parametrize("gone", ["hopscale.llm.queries", "corpus_pipeline", "xxhash"])
def test_optional_parts_may_be_missing(monkeypatch, gone):
    """Without a part, or what it needs, the other queries are there, and a warning says so."""
    for name in [n for n in sys.modules if n.startswith(("hopscale.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    with pytest.warns(UserWarning, match="left out"):
        q = entry.queries()
    assert set(QUERIES) <= set(q)
    assert ("pipeline" in q) == (sys.modules.get("corpus_pipeline") is not None)
    for name in [n for n in sys.modules if n.startswith(("hopscale.llm", "corpus_pipeline"))]:
        del sys.modules[name]
