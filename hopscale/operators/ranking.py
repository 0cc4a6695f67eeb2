"""Global ranks without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hopscale.scratch import Scratch


SMALL = 1_000_000


def ranked(tmp: Scratch, df: DataFrame, keys: list[str], name: str, small: int = SMALL) -> DataFrame:
    """df with `rank` from 0 in the order of the keys, which must be unique.

    Up to `small` rows, which are counted, one task ranks them. Beyond, rows are dealt by ranges of the keys and written, so a range keeps its number. A rank is the place in
    the range plus the rows of the ranges before; only these counts, one for each range, are summed in one task.
    """
    if df.count() <= small:
        return df.withColumn("rank", F.row_number().over(W.orderBy(*keys)) - 1)
    dealt = tmp.put(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*keys)) - 1
    return dealt.withColumn("_place", place).join(before, "_range").withColumn("rank", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
