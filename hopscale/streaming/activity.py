"""Accessibility kept up to date from a stream of changes in activity.

The operator is linear, so a batch of changes moves the result by the operator applied to the changes.
Totals are Parquet versions in a folder; a batch writes the version of its own number from the one
before, so a batch that is run again gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.operators.interaction import InteractionHierarchy


class RunningAccessibility:
    """Totals after each micro-batch, under path/v=<number>; version 0 is zero everywhere."""

    def __init__(self, ih: InteractionHierarchy, path: str):
        self.ih, self.path = ih, path.rstrip("/")
        ih.hierarchy.zones.select("zone", F.lit(0.0).alias("value")).write.mode("overwrite").parquet(self._at(0))

    def _at(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def version(self, version: int) -> DataFrame:
        return self.ih.spark.read.schema("zone long, value double").parquet(self._at(version))

    def add(self, changes: DataFrame, batch_id: int) -> None:
        """For foreachBatch: changes (zone, value) of micro-batch number batch_id, from 0."""
        moved = self.version(batch_id).unionByName(self.ih.apply(changes))
        moved.groupBy("zone").agg(F.sum("value").alias("value")).write.mode("overwrite").parquet(self._at(batch_id + 1))


def windowed_activity(events: DataFrame, *, time: str, zone: str, value: str, every: str, late: str) -> DataFrame:
    """(start, zone, value): sums by tumbling window of event time; rows later than `late` are dropped by the watermark."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = e.groupBy(F.window(time, every).alias("w"), F.col(zone).alias("zone")).agg(F.sum(value).alias("value"))
    return w.select(F.col("w.start").alias("start"), "zone", "value")
