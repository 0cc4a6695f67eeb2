"""Operator 7: proportional stratified interleaving into shards.

Rows of a source get ranks in a seeded order; (rank - 1/2) / rows of the source places them on [0, 1);
sorting all rows by that fraction interleaves the sources in proportion, and equal cuts of the order
give shards of equal row counts (at most one apart), each with the whole table's mixture.

Equal texts. The seeded order is that of a hash of the text, so equal texts are neighbours in a source
and, because hashes are spread evenly, near each other across sources: a group is split only where a cut
falls into it, as it must where a group is larger than a shard. With `spread` the order hashes the id and
the number of the copy too, so that copies are dealt like any other rows; a mixture that repeats rows
needs that.

Scale. No source and no shard is ever sorted in one task. Ranks are offsets of ranges of the order plus
the rank inside the range; the offsets come from counts by range, at most 2**16 for a source. A range of
more than HOT rows (copies of one text share a hash) is cut again by a hash of the id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hopscale.llm.text import free
from hopscale.scratch import Scratch, small

RANGE_ROWS, HOT = 1024, 4096


def _range_bits(n_rows: int) -> int:
    return min(16, max(4, math.ceil(math.log2(max(1, n_rows / RANGE_ROWS)))))


def _ranked(tmp: Scratch, rows: DataFrame, name: str, by: list[str], range_: Column, order: list[str], out: str, salt: Column | None = None) -> DataFrame:
    """rows with `out`, the rank from 0 within `by`, sorted by range_ and within a range by `order`; ranges of more than HOT rows are sorted by salt first."""
    rows = rows.withColumn("_r", range_).withColumn("_r2", F.lit(0).cast("long"))
    if salt is not None:
        crowded = tmp.put(rows.groupBy(*by, "_r").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).drop("_n").withColumnsRenamed({c: f"_h{c}" for c in [*by, "_r"]}).withColumn("_hot", F.lit(True)), f"{name}_hot")
        if not crowded.isEmpty():
            on = [F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in [*by, "_r"]]
            rows = rows.join(small(crowded), on, "left").withColumn("_r2", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot", *[f"_h{c}" for c in [*by, "_r"]])
    cells = [*by, "_r", "_r2"]
    counts = rows.groupBy(*cells).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_r", "_r2"))
    offsets = tmp.put(counts.withColumn("_off", upto - F.col("_n")).drop("_n").withColumnsRenamed({c: f"_o{c}" for c in cells}), name)
    on = [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in cells]
    inside = F.row_number().over(W.partitionBy(*cells).orderBy(*order)) - 1
    return rows.withColumn("_in", inside).join(offsets, on).withColumn(out, F.col("_off") + F.col("_in")).drop("_in", "_off", "_r", "_r2", *[f"_o{c}" for c in cells])


def _numbered(tmp: Scratch, rows: DataFrame) -> DataFrame:
    """rows with `_copy`, a number from 0 among rows of equal id and text. Numbers follow the task that wrote a row, so no task holds all copies."""
    same = ["doc_id", "_t"]
    many = rows.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_md"), F.col("_t").alias("_mt"), F.lit(True).alias("_many"))
    many = tmp.put(many, "repeated")
    if many.isEmpty():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    marked = rows.join(small(many), F.col("doc_id").eqNullSafe(F.col("_md")) & (F.col("_t") == F.col("_mt")), "left").drop("_md", "_mt")
    one = marked.where("_many is null").drop("_many").withColumn("_copy", F.lit(0).cast("long"))
    some = _ranked(tmp, marked.where("_many").drop("_many"), "copies", same, F.col("_task"), ["_task"], "_copy")
    return one.unionByName(some)


def _placed(tmp: Scratch, rows: DataFrame, n_shards: int, seed: int, spread: bool) -> DataFrame:
    """Written rows (doc_id, source, size, text_crc32, _t, _task, ...) with shard and slot; all narrow."""
    own = [c for c in rows.columns if c not in ("_t", "_task")]
    sources = tmp.put(rows.groupBy("source").agg(F.count("*").alias("_rows")).withColumnRenamed("source", "_s"), "sources")
    total = tmp.put(sources.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_all")), "total")  # one row
    bits = _range_bits(total.first()[0])
    rows = _numbered(tmp, rows) if spread else rows.withColumn("_copy", F.lit(0).cast("long"))
    each = F.xxhash64("doc_id", "_t", "_copy", F.lit(seed))
    rows = rows.withColumns({"_key": each if spread else F.xxhash64("_t", F.lit(seed)), "_each": each})
    order = ["_key", "_each", "doc_id", "size", "text_crc32", "_t"]
    rows = _ranked(tmp, rows, "offsets1", ["source"], F.shiftrightunsigned("_key", 64 - bits), order, "_rank", F.shiftrightunsigned("_each", 48))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = tmp.put(rows.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_rows")).select(*own, "_t", "_key", "_each", "_at"), "placed")
    rows = _ranked(tmp, rows, "offsets2", [], F.floor(F.col("_at") * (1 << bits)), ["_at", "source", *order], "_place")
    rows = rows.crossJoin(F.broadcast(total))  # one row
    # shard k holds the places from ceil(k * all / n) on: counts differ by one at most
    shard = F.expr(f"cast((_place * {n_shards}L) div _all as int)")
    first = F.expr(f"(shard * _all + {n_shards - 1}L) div {n_shards}L")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("_place") - first).select(*own, "shard", "slot")


def _narrow(doc_id: str, text: str, source: str, seed: int) -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t, F.lit(seed)).alias("_t"), F.spark_partition_id().alias("_task")]


def shard_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_shards: int = 8, seed: int = 7, spread: bool = False) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) for every row of docs.

    Null texts are empty, null sources form a source of their own, null ids take part like any other.
    Rows that agree in all these columns are interchangeable and get places of their own. Extra columns
    are not read. An empty table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    tmp = Scratch(docs.sparkSession)
    return _placed(tmp, tmp.put(docs.select(*_narrow(doc_id, text, source, seed)), "rows"), n_shards, seed, spread)


def shard_docs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_shards: int = 8, seed: int = 7, spread: bool = False) -> DataFrame:
    """All rows and columns of docs with a struct column `_place` of shard and slot, as shard_rows places them.

    Rows are written once with a number that is unique whatever repeats, places are worked out on narrow
    rows, and one join by the number brings them together. It is a merge join at any size: a broadcast would
    hold a place for each row, and where it ended the disk needed would jump by all rows. Nulls and repeated
    rows as for shard_rows. If docs has a column `_place`, the new one has one more underscore, and so on; it
    is the last column.
    """
    tmp = Scratch(docs.sparkSession)
    number, place, id_, row = (free(c, docs) for c in ("_number", "_place", "_of", "_row"))
    whole = tmp.put(docs.select("*", F.monotonically_increasing_id().alias(number)), "whole")
    rows = tmp.put(whole.select(*_narrow(doc_id, text, source, seed), F.col(number).alias(id_)), "rows")
    places = _placed(tmp, rows, n_shards, seed, spread)
    places = tmp.put(places.select(F.col(id_), F.struct("shard", "slot").alias(place)), "places")
    tmp.drop("rows", "placed", "offsets1", "offsets2")
    wide = whole.select(F.struct(*[whole[c] for c in docs.columns]).alias(row), number)
    return wide.join(places.hint("merge"), F.col(number) == F.col(id_)).select(f"{row}.*", place)


def write_shards(placed: DataFrame, path: str, *, place: str | None = None, files: int | None = None) -> None:
    """Write what shard_docs returns as Parquet by shard: folders shard=0, 1, ..., whose files, in the order of their names, hold the rows in the order of their slots.

    Ranges of (shard, slot) are dealt to `files` tasks (by default one for each 128 MB of the planner's
    estimate), so a shard is written by many. Rows may repeat and ids may be null. All columns are
    written, and the slot; a column `shard` or `slot` of placed itself gets underscores added.
    """
    name = place or placed.columns[-1]
    own = [c for c in placed.columns if c != name]
    renamed = {c: free(f"{c}_", placed) for c in own if c.lower() in ("shard", "slot")}
    rows = placed.select(*[F.col(c).alias(renamed.get(c, c)) for c in own], F.col(f"{name}.shard").alias("shard"), F.col(f"{name}.slot").alias("slot"))
    if files is None:
        size = int(str(placed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files = max(placed.sparkSession.sparkContext.defaultParallelism, min(1_000_000, size >> 27))
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
