"""A corpus from raw documents: quality, near-duplicates, benchmark leaks, mixture, shards.

The last stage returns the corpus itself: the columns of documents, and each row's shard and slot.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and calls one
operator of hopscale.llm. `run` writes each stage's result as Parquet in the shared folder and reads it
back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale.llm import decontaminate, mixing, quality_model, sharding, simhash
from hopscale.llm.text import n_space_words, whole
from hopscale.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, labels, host="source", path="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Links are pairs whose sets of five-word shingles have an exact Jaccard similarity of at least 0.8.
    """
    return simhash.keep_one(docs, shingle=5, threshold=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of a benchmark item's shingles go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the weighted mix of sources takes."""
    return mixing.expand(mixing.mix_sources(docs, size=n_space_words("text"), key=F.xxhash64(whole("text"))))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The whole rows with their shard and slot; every shard has the whole mixture, and copies of a document are dealt like other rows.

    sharding.write_shards writes what sharding.shard_docs returns, a file for each range of slots.
    """
    placed = sharding.shard_docs(docs, spread=True)
    return placed.select(*placed.columns[:-1], F.col(f"{placed.columns[-1]}.shard").alias("shard"), F.col(f"{placed.columns[-1]}.slot").alias("slot"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    tmp = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tmp.put(docs, name)
            if k:
                tmp.drop(STAGES[k - 1][0])
    return docs


#: The classifier, near-duplicate components and seeded sampling cannot be said in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
