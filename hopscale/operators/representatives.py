"""Representatives of a layer and the zones' assignment to them.

A zone becomes a representative unless a smaller-numbered one is near: the lexicographically first
maximal independent set of the near pairs. Up to `max_driver_pairs` pairs, a checked bound, are scanned
once on the driver; beyond it, ids are settled in prefixes of about that many pairs, one scan each, so the
number of scans is that of the pairs divided by the bound, whatever the order of the ids. Both give the
same set.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.scratch import Scratch, small

MAX_DRIVER_PAIRS = 1_000_000


def _lost(pairs, before: int | None = None) -> list[int]:
    """Zones that lose, from an Arrow table of pairs (src, dst), dst < src. All dst under `before` are representatives."""
    smaller: dict[int, list[int]] = {}
    for s, t in zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True):
        smaller.setdefault(s, []).append(t)
    out: set[int] = set()
    for s in sorted(smaller):
        # zones without a smaller neighbour never lose, so a neighbour that has not lost by now has won
        if any((before is not None and t < before) or t not in out for t in smaller[s]):
            out.add(s)
    return sorted(out)


def scan(down: DataFrame, max_driver_pairs: int = MAX_DRIVER_PAIRS) -> list[int] | None:
    """Zones that the scan of pairs (src, dst), dst < src, leaves out; null if there are more pairs than the driver takes."""
    some = down.limit(max_driver_pairs + 1).toArrow()
    return _lost(some) if some.num_rows <= max_driver_pairs else None


def first_independent_set(tmp: Scratch, zones: DataFrame, near: DataFrame, name: str, max_driver_pairs: int = MAX_DRIVER_PAIRS) -> DataFrame:
    """zones (zone), near (src, dst) in both directions -> the set (zone), and how many zones it leaves out."""
    down = near.where("dst < src").select("src", "dst")
    gone = scan(down, max_driver_pairs)
    if gone is not None:
        lost = zones.sparkSession.createDataFrame([(s,) for s in gone], "zone long")
        return tmp.put(zones.join(lost, "zone", "left_anti"), f"{name}_reps"), len(gone)
    return prefixes(tmp, zones, down, name, max_driver_pairs)[:2]


def prefixes(tmp: Scratch, zones: DataFrame, down: DataFrame, name: str, limit: int) -> tuple[DataFrame, int, int]:
    """(the independent set, number of zones left out, number of scans); a scan takes up to `limit` pairs, or all of one zone if it alone has more."""
    down = tmp.put(down.repartitionByRange("src").sortWithinPartitions("src"), f"{name}_near")
    total = down.count()
    parts = math.ceil(2 * total / limit)
    cuts = down.agg(F.percentile_approx("src", [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("c")).first().c if parts > 1 else []
    lost, n_lost, k = None, 0, 0
    # of a range of ids, pairs with a zone that lost before do not matter
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        own = down
        if low is not None:
            own = own.where(F.col("src") > low)
        if high is not None:
            own = own.where(F.col("src") <= high)
        if lost is not None:
            own = own.join(small(lost.withColumnRenamed("zone", "dst")), "dst", "left_anti").select("src", "dst")
        k += 1
        gone = _lost(own.toArrow(), None if low is None else low + 1)
        n_lost += len(gone)
        zones.sparkSession.createDataFrame([(s,) for s in gone], "zone long").write.mode("append").parquet(f"{tmp.path}/{name}_lost")
        lost = zones.sparkSession.read.schema("zone long").parquet(f"{tmp.path}/{name}_lost")
    reps = tmp.put(zones.join(lost, "zone", "left_anti") if lost is not None else zones, f"{name}_reps")
    tmp.drop(f"{name}_near", f"{name}_lost", free=False)
    return reps, n_lost, k


def assign(zones: DataFrame, reps: DataFrame, near: DataFrame) -> DataFrame:
    """(zone, rep): a representative stands for itself, others go to the nearest near one, ties to the smallest."""
    to = near.join(reps.select(F.col("zone").alias("dst")), "dst").groupBy(F.col("src").alias("zone")).agg(F.min(F.struct("cost", "dst"))["dst"].alias("rep"))
    own = reps.select("zone", F.col("zone").alias("rep"))
    return own.unionByName(to.join(reps, "zone", "left_anti"))
