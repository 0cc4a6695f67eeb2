"""Queries against their SQL on the smallest tables, and the pipeline against its operators."""

from collections import Counter

import pytest

import corpus_pipeline
from hopscale.llm import queries, sharding

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    want = c.execute(queries.ORACLES[name]).fetchall()
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    counts, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, D).collect(), docs.schema)
        assert now.columns == docs.columns, name
        counts.append(now.count())
    # quality, near-duplicates and leaks only remove
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    out = corpus_pipeline.run(spark, D).collect()
    last = corpus_pipeline.STAGES[-1][1](spark, now, D)
    assert last.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(tuple, out)) == sorted(map(tuple, last.collect())) and len(out) == counts[4]
    # every row of the mixture is in a shard, whole
    assert Counter(map(tuple, now.collect())) == Counter(tuple(r)[:5] for r in out)
    rows = Counter(r.shard for r in out)
    assert max(rows.values()) - min(rows.values()) <= 1 and all(sorted(r.slot for r in out if r.shard == k) == list(range(n)) for k, n in rows.items())
    # copies are dealt like other rows: few stand right behind their original within their source
    out.sort(key=lambda r: (r.shard, r.slot))
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r.doc_id)
    copies = len(out) - len({r.doc_id for r in out})
    assert copies > 50 and sum(a == b for v in by.values() for a, b in zip(v, v[1:], strict=False)) < copies / 3


def test_written_shards_hold_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    mixed = corpus_pipeline.mixture(spark, docs, D)
    placed = sharding.shard_docs(mixed, spread=True)
    sharding.write_shards(placed, str(tmp_path / "out"), files=16)
    back = spark.read.parquet(str(tmp_path / "out")).select(*corpus_pipeline.COLUMNS).collect()
    assert Counter(map(tuple, back)) == Counter(map(tuple, mixed.collect()))


def test_stages_take_anything(spark):
    from test_operators import SCHEMA, nasty

    docs = spark.createDataFrame(nasty(3), SCHEMA).withColumnRenamed("size", "n_chars")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, D)
            assert out.columns == some.columns, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, some, D).count() == some.count()
