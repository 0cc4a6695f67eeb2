"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

A document is a leak of an item if it holds at least `threshold` of the item's distinct five-word
shingles. Items are partitioned by size (powers of two of their shingle counts). The sketch of an item
is the bottom of its MinHash order, floor((1 - threshold) * upper) + 1 values for a partition whose
largest size is `upper`. A leak misses at most floor((1 - threshold) * size) shingles, so it holds at
least one value of the sketch: looking up the documents' shingles in the sketches finds every leak,
however long the document is. Candidates are then verified by exact containment of shingle strings.

Scale. Only candidate pairs are shuffled. The sketch index is written first; Spark broadcasts it if its
size on disk is below the threshold and shuffles by hash value otherwise. Equal items are one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.llm.text import let, whole, without
from hopscale.scratch import Scratch, small

SHINGLE = 5
#: Separators: all ASCII that is no letter or digit.
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(whole(text)), OTHER, -1), lambda w: w != "")


def _starts(words: Column, k: Column) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def _hashes(h: Column, k: int) -> Column:
    """Hashes of the k-word shingles, from the words' hashes."""
    return F.transform(_starts(h, F.lit(k)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))


def _strings(words: Column, k: Column) -> Column:
    """Distinct k-word shingles."""
    return F.array_distinct(F.transform(_starts(words, k), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, same_items, k, shingles, _h): one row for each set of shingles; item_id is the smallest of its items.

    Items of fewer than five words have their whole sequence as the only shingle, of k words; items
    without words match nothing and have no class.
    """
    i = items.select(F.col(item_id).alias("item_id"), words_of(text).alias("_words")).where(F.size("_words") > 0)
    i = i.withColumn("k", F.least(F.size("_words"), F.lit(SHINGLE))).withColumn("shingles", let(F.col("_words"), lambda w: _strings(w, F.col("k"))))
    i = i.groupBy("k", F.sort_array("shingles").alias("shingles")).agg(F.min("item_id").alias("item_id"), F.sort_array(F.collect_list("item_id")).alias("same_items"))
    h = F.transform("shingles", lambda s: F.transform(F.split(s, " "), lambda w: F.xxhash64(w)))
    per_k = F.lit(None)
    for k in range(1, SHINGLE + 1):
        per_k = F.when(F.col("k") == k, F.transform("_wh", lambda x: F.xxhash64(*[F.get(x, F.lit(j)) for j in range(k)]))).otherwise(per_k)  # noqa: B023
    return i.withColumn("_wh", h).withColumn("_h", per_k).drop("_wh")


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, tmp: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, item_id, same_items, n_shingles, n_found, containment): leaks only.

    Null texts are empty and leak nothing. Null ids are kept as null. Repeated rows with equal id and
    text give one row. Extra columns are not read. With no items or no documents the result is empty.
    """
    tmp = tmp or Scratch(docs.sparkSession)
    classes = tmp.put(item_classes(items), "classes")
    size = F.size("_h")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(size)) + 1) - 1
    length = F.least(size, (F.floor(F.lit(1 - threshold + 1e-9) * upper) + 1).cast("int"))
    index = tmp.put(classes.select("item_id", "k", F.explode(F.slice(F.sort_array("_h"), F.lit(1), length)).alias("h")), "index")
    ks = sorted(r.k for r in index.select("k").distinct().collect())  # at most five

    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.concat(*[_hashes(h, k) for k in ks])) if ks else F.array().cast("array<bigint>")
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole(text)).alias("text_key"), F.explode(grams).alias("h")).join(index, "h").select("doc_id", "text_key", "item_id").distinct()
    pairs = tmp.put(pairs, "pairs")

    keyed = docs.select(F.col(doc_id).alias("_i"), F.xxhash64(whole(text)).alias("_k"), F.col(text).alias("_t"))
    each = keyed.join(small(pairs), F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("text_key")))
    each = each.join(classes.select("item_id", "same_items", "k", "shingles"), "item_id")
    found = let(words_of("_t"), lambda w: F.size(F.array_intersect("shingles", _strings(w, F.col("k")))))
    each = each.withColumn("n_found", found.cast("long"))
    each = each.withColumn("n_shingles", F.size("shingles").cast("long")).where(F.col("n_found") >= F.lit(threshold - 1e-9) * F.col("n_shingles"))
    each = each.groupBy("doc_id", "text_key", "item_id").agg(*[F.first(c).alias(c) for c in ("same_items", "n_shingles", "n_found")])
    return each.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs without the rows that leak an item; all columns stay, whatever their names. Nulls and repeats as for find_leaks."""
    tmp = Scratch(docs.sparkSession)
    found = find_leaks(docs, items, doc_id=doc_id, text=text, threshold=threshold, tmp=tmp)
    return without(docs, tmp.put(found.select("doc_id", "text_key").distinct(), "leaks"), doc_id, text)
