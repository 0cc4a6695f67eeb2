"""The join that brings places to whole rows is the same at any size, so the disk needed follows the input without a jump."""

from collections import Counter

from hopscale.llm import sharding


def test_places_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, f"text {k % 7}", "ab"[k % 2]) for k in range(50)], "doc_id long, text string, source string")
    placed = sharding.shard_docs(docs, spread=True)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert Counter(tuple(r)[:3] for r in placed.collect()) == Counter(map(tuple, docs.collect()))
