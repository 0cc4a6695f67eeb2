"""Operator 1: mix sources to target weights with Pareto order sampling.

Targets. Each source has a weight; together the sources share `budget` times all words. No target
exceeds `max_copies` times its source; what a capped source cannot take is shared again by weight.
Both steps are one water-filling: target = min(cap, level * weight).

Inclusion. A document's expected number of copies is min(max_copies, c / size ** tilt), with c such
that the expected words of a source are its target. So long documents get lower odds and a few of
them cannot dominate a source. The integer part is allocated with certainty. The rest p is the
inclusion probability of a Pareto sample: documents are ranked by u/(1-u) divided by p/(1-p) and the
first ones are taken until the source's remaining words are met. The sample's size is fixed in words,
the unit of the targets; its error is at most half of the one document at the cut.

Scale. A source's order is cut without sorting the source: words are summed by 2**16 ranges of the
order, the range that holds the cut is found from these sums, and only its documents are sorted. So a
source with a third of all rows is dealt over all tasks. Tables by source are as long as the list of
sources, which one task sorts to find the common level: some ten million sources, not billions. Those
by (source, size) are as long as the list of distinct sizes. Joins with them are broadcast only if
their written size is below Spark's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hopscale.llm.text import free, uniform
from hopscale.operators.ranking import ranked
from hopscale.scratch import Scratch

RANGES = 65536
_EPS = 1e-9


def _level(df: DataFrame, by: list[str], cap: Column, weight: Column, budget: Column) -> DataFrame:
    """(by, level): sum of min(cap, level * weight) equals the budget; null level where all caps together do not exceed it."""
    # the constant key only stands in for an empty list of keys
    keys = by or [F.lit(1)]
    df = df.withColumns({"_cap": cap, "_w": weight, "_b": budget}).where("_w > 0")
    order = W.partitionBy(*keys).orderBy(F.col("_cap") / F.col("_w"), "_rank")
    df = df.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("_after", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
    df = df.withColumns({"_level": (F.col("_b") - F.col("_before")) / F.col("_after"), "_ratio": F.col("_cap") / F.col("_w")})
    open_ = F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))
    return df.groupBy(*by).agg(F.min(open_)["_level"].alias("level"))


def source_targets(tmp: Scratch, sizes: DataFrame, weights: tuple[float, ...], budget: float, max_copies: int) -> DataFrame:
    """sizes (source, source_size) -> (source, source_size, target). Weights repeat over the sources by code point, null last."""
    s = ranked(tmp, sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "source_ranges").withColumnRenamed("rank", "_rank").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int")))
    total = s.agg(F.sum("source_size").cast("double").alias("total"))
    s = s.crossJoin(F.broadcast(total))  # one row
    level = _level(s, [], F.col("source_size") * float(max_copies), F.col("weight"), F.col("total") * budget)
    cap = F.col("source_size") * F.lit(float(max_copies))
    s = s.crossJoin(F.broadcast(level))  # one row
    return s.select("source", "source_size", F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", size: str | Column = "size", source: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, max_copies: int = 2, tilt: float = 0.5, seed: int = 20, targets: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """All rows and columns of docs, with a struct column `_mix` of source_size, target, copies and taken.

    `targets` (source, target) replaces the weights. A null source is a source of its own, the last.
    A null or zero size takes nothing. A null id has the draw of null. `key` (a hash of the text, say)
    tells rows of one id apart. Rows with equal id, key, size and source are interchangeable: their
    draws tie and the cut may take some of them only. An empty table gives an empty one. All columns
    stay; if docs has a column `_mix`, the new one has one more underscore, and so on; it is the last.
    """
    key = F.lit(None).cast("long") if key is None else key
    tmp = Scratch(docs.sparkSession)
    words = F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)).cast("long").alias("size")
    rows = docs.select(F.col(source).alias("source"), words)
    hist = tmp.put(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sizes = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    if targets is None:
        plan = source_targets(tmp, sizes, weights, budget, max_copies)
    else:
        t = targets.select(F.col("source").alias("_s"), F.col("target").cast("double").alias("_t"))
        plan = sizes.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", F.least(F.coalesce("_t", F.lit(0.0)), F.col("source_size") * float(max_copies)).alias("target"))
    plan = tmp.put(plan, "targets")

    # expected copies: the same water-filling inside each source, over its distinct sizes
    cells = _with(hist.where("size > 0"), plan).withColumn("_rank", F.col("size"))
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    level = _level(cells, ["source"], n * s * float(max_copies), n * F.pow(s, F.lit(1.0 - tilt)), F.col("target"))
    plan = plan.join(level.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sure = _with(hist.where("size > 0"), plan).groupBy("source").agg(F.sum(F.col("n") * F.col("size") * _whole(max_copies, tilt)).alias("_sure"))
    plan = plan.join(sure.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = tmp.put(plan.withColumn("rest", F.col("target") - F.coalesce("_sure", F.lit(0.0))), "plan")

    def drawn_at(df: DataFrame) -> DataFrame:
        p = F.least(F.greatest(_expected(max_copies, tilt) - _whole(max_copies, tilt), F.lit(0.0)), F.lit(1.0))
        u = uniform("id", "key", seed=seed)
        q = F.try_divide(u / (1 - u), p / (1 - p))
        return df.withColumn("_v", F.when((p > _EPS) & (F.col("size") > 0), q / (1 + q))).withColumn("_range", F.when(F.col("_v").isNotNull(), F.least(F.floor(F.col("_v") * RANGES), F.lit(RANGES - 1))).cast("int"))

    ids = [F.col(doc_id).alias("id"), key.alias("key"), F.col(source).alias("source"), words]
    drawn = drawn_at(_with(docs.select(*ids), plan)).where("_v is not null")
    sums = drawn.groupBy("source", "_range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("_range"))
    at = _with(sums.withColumn("before", upto - F.col("words")), plan).where(F.col("before") + F.col("words") > F.col("rest"))
    at = at.groupBy("source").agg(F.min(F.struct("_range", "before")).alias("c"))
    plan = plan.join(at.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    plan = tmp.put(plan.select("source", "source_size", "target", "level", "rest", F.coalesce("c._range", F.lit(RANGES)).alias("cut"), F.coalesce("c.before", F.lit(0)).alias("before")), "cuts")

    keep = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    every = drawn_at(_with(docs.select(keep, *ids), plan)).withColumn("_whole", _whole(max_copies, tilt))
    plain = every.where("_v is null or _range <> cut").withColumn("_more", F.coalesce((F.col("_range") < F.col("cut")).cast("int"), F.lit(0)))
    order = W.partitionBy("source").orderBy("_v", "id", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = every.where("_v is not null and _range = cut").withColumn("_so_far", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("_more", (F.col("_so_far") + F.col("size") / 2.0 <= F.col("rest")).cast("int")).drop("_so_far")
    copies = (F.col("_whole") + F.col("_more")).cast("int")
    made = plain.unionByName(cut).select("_row", F.struct("source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")).alias("_made"))
    return made.select("_row.*", F.col("_made").alias(free("_mix", docs)))


def _with(df: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "_s")
    return df.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _expected(max_copies: int, tilt: float) -> Column:
    """Expected copies of a document of that size, from its source's level."""
    r = F.least(F.lit(float(max_copies)), F.col("level") * F.pow(F.col("size").cast("double"), F.lit(-tilt)))
    return F.when(F.col("size") <= 0, 0.0).when(F.col("level").isNull(), float(max_copies)).otherwise(r)


def _whole(max_copies: int, tilt: float) -> Column:
    return F.floor(_expected(max_copies, tilt) + _EPS).cast("int")


def expand(mixed: DataFrame, mix: str | None = None) -> DataFrame:
    """One row for each copy that the mix takes, without the mix's column (by default the last one).

    All other columns stay as they are, whatever their names, nulls included; repeated rows are repeated
    as often as each of them is taken. Nothing taken, or an empty table, gives an empty table.
    """
    name = mix or mixed.columns[-1]
    copy = free("_copy", mixed)
    repeats = F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))
    return mixed.where(F.col(f"{name}.copies") > 0).select("*", repeats.alias(copy)).drop(name, copy)
