"""Near-duplicates by the exact Jaccard similarity of word shingles, for the pipeline.

Candidates are found by operator 5's method, at distances that a threshold of 0.8 needs: SimHash fingerprints
and pigeonring chains (`rings`). A pair at 0.8 is missed with chance 1.3e-7, a closer pair with less. Nothing
is linked by fingerprints alone: the shingle sets of candidates are compared exactly, all that may reach the
threshold and are not linked yet.

Equal sets are one node. What the candidates' links connect is one place, and a set is in one place only.
All pairs of a place are compared, but a member that is linked already is left out of later comparisons; a
place emits a spanning forest, not its pairs. A place of more than CROWDED / 4 hashes may be a loose chain, and
gives way to the groups of its single fingerprints, which are tighter. Groups with the same members are
compared once.

A task holds the sets of one place, of CROWDED hashes at most. A place with more is cut into parts. Each part
is compared together with the first one; that links nearly all of a true group of copies. Then whoever is
not in the place's largest component is compared with every part. A link that is still missing has an end
outside that component, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.llm.rings import candidates, groups, prints, set_number, short
from hopscale.operators.components import components
from hopscale.scratch import Scratch, small

BANDS, WIDTH = 40, 5
#: Most hashes of one place's sets that one task compares.
CROWDED = 1 << 23
_BLOCK = 2048
_RANDOM = np.random.Generator(np.random.PCG64(42))
_TIMES, _PLUS, _MIX = (_RANDOM.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * WIDTH, BANDS * WIDTH, BANDS * WIDTH))
_TIMES |= np.uint64(1)
_MIX |= np.uint64(1)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of a shorter text, of all its words; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """Signed keys of the MinHash bands; none for an empty set. A yardstick: the stage's candidates come from `rings`."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _BLOCK):
        x = own[at : at + _BLOCK] * _TIMES[:, None]
        x += _PLUS[:, None]
        np.minimum(low, x.min(1), out=low)
    x = (low ^ (low >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))).reshape(BANDS, WIDTH).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def forest(flat: np.ndarray, size: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Edges that link sets just as all their pairs of at least that similarity would. flat: the sets behind one another."""
    _, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, np.int64)
    ends = np.cumsum(size)
    own = lambda i: flat[ends[i] - size[i] : ends[i]]
    left, rows, lengths = np.arange(len(size)), flat, size
    u, v, ahead = [], [], []
    while len(left):
        if ahead:
            i = ahead.pop()
        else:
            i = int(left[0])
            rows, left, lengths = rows[lengths[0] :], left[1:], lengths[1:]
            if not len(left):
                break
        mark[own(i)] = 1
        common = np.add.reduceat(mark[rows], np.cumsum(lengths) - lengths)
        mark[own(i)] = 0
        near = common / (size[i] + lengths - common) >= threshold
        if near.any():
            hit = left[near].tolist()
            u += [i] * len(hit)
            v += hit
            ahead += hit
            rows, left, lengths = rows[np.repeat(~near, lengths)], left[~near], lengths[~near]
    return u, v


def _places(tmp: Scratch, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(place, node, n): which sets meet, of candidates near (deal, node, root); nodes: (node, n)."""
    # what all fingerprints connect, one place for a set
    joined = components(tmp, near.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "near_cc")
    joined = tmp.put(joined.select(F.col("node").alias("_n"), F.col("root").alias("place")).join(nodes, F.col("_n") == F.col("node")).select("place", "node", "n"), "joined")
    wide = tmp.put(joined.groupBy(F.col("place").alias("_p")).agg(F.sum("n").alias("all")).where(F.col("all") * 4 > F.lit(CROWDED)).select("_p"), "wide")
    if wide.isEmpty():
        return joined
    wide = small(wide)
    some = tmp.put(joined.join(wide, F.col("place") == F.col("_p")).select(F.col("node").alias("_n"), "n"), "in_wide")
    found = tmp.put(near.join(some, F.col("node") == F.col("_n")).select("deal", "root", "node", "n"), "groups")
    # groups of equal members get one place; if others did by chance, they would only meet in addition
    same = F.xxhash64(F.count("*"), F.min("node"), F.bit_xor(F.xxhash64("node")))
    same = found.groupBy(F.col("deal").alias("_d"), F.col("root").alias("_r")).agg(same.alias("place"))
    single = found.join(same, (F.col("deal") == F.col("_d")) & (F.col("root") == F.col("_r"))).select("place", "node", "n").distinct()
    return tmp.put(joined.join(wide, F.col("place") == F.col("_p"), "left_anti").unionByName(single), "places")


def _in_parts(tmp: Scratch, members: DataFrame, known: DataFrame, compared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """known edges and those of the crowded places: members (place, node, n, parts), of which compared makes the edges of places."""
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    number = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    place = lambda *by: F.xxhash64("place", *by).alias("place")
    rows = tmp.put(members.withColumn("part", number("parts", 1)), "parts")
    meets = rows.withColumn("meets", F.explode(F.when(F.col("part") == 0, upto("parts")).otherwise(F.array("part"))))
    known = tmp.put(known.unionByName(compared(meets.select(place("meets"), "node"))), "part_edges")
    roots = tmp.put(components(tmp, known, "part_cc").withColumnRenamed("node", "_n"), "part_roots")
    rows = tmp.put(rows.join(roots, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).drop("_n"), "rooted")
    largest = rows.groupBy("place", "root").agg(F.count("*").alias("c")).groupBy(F.col("place").alias("_p")).agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    left = tmp.put(rows.join(largest, F.col("place") == F.col("_p")).where("root <> main").drop("_p", "main", "root"), "outside")
    cuts = tmp.put(left.groupBy(F.col("place").alias("_p")).agg(F.ceil(F.sum("n") * 2 / F.lit(CROWDED)).cast("int").alias("cuts")), "cuts")
    if cuts.isEmpty():
        return known
    with_cuts = lambda df: df.join(small(cuts), F.col("place") == F.col("_p"))
    every = with_cuts(rows).withColumn("cut", F.explode(upto("cuts"))).select(place("part", "cut"), "node")
    outside = with_cuts(left).withColumn("cut", number("cuts", 2)).withColumn("part", F.explode(upto("parts"))).select(place("part", "cut"), "node")
    return tmp.put(known.unionByName(compared(every.unionByName(outside).distinct())), "all_edges")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, tmp: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, component_id, component) for every row of docs; component: a number.

    component_id is the smallest id that links of at least that Jaccard similarity reach. Null and wordless
    texts have equal, empty sets. Rows with a null id take part; only if a whole component has no id is its
    component_id null. Extra columns are not read. An empty table gives an empty result.
    """
    tmp = tmp or Scratch(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, shingle) for x in b.column(2).cast(pa.binary()).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(np.array([set_number(x) for x in sets], np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64())]
            columns += [pa.array([f(x) for x in sets], pa.list_(pa.int64())) for f in (prints, short)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "fps", "less"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, shingle).view(np.int64) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "own"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, own in groups(batches):
            node = node.to_numpy()
            u, v = forest(own.flatten().to_numpy(), np.diff(own.offsets.to_numpy()), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    whole = tmp.put(read.mapInArrow(hashed, "doc_id long, text_key long, node long, n long, fps array<long>, less array<long>"), "whole")
    rows = tmp.put(whole.select("doc_id", "text_key", "node"), "rows")
    nodes = whole.groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("fps").alias("fps"), F.first("less").alias("less"))
    printed = tmp.put(nodes, "prints")
    nodes = tmp.put(printed.drop("fps"), "nodes")
    tmp.drop("whole")
    near = candidates(tmp, printed.where("n > 0").select("node", "fps"))
    tmp.drop("prints")
    places = _places(tmp, nodes.select("node", "n"), near)
    # texts are read again for candidates only
    some = places.select(F.col("node").alias("_n")).distinct()
    some = tmp.put(nodes.join(some, F.col("node") == F.col("_n")).select("node", F.col("at.doc_id").alias("_i"), F.col("at.text_key").alias("_k")), "some")
    some = small(some)
    texts = read.join(some, read["doc_id"].eqNullSafe(some["_i"]) & (read["text_key"] == some["_k"])).select("node", "text")
    sets = tmp.put(texts.mapInArrow(again, "node long, own array<long>").groupBy("node").agg(F.first("own").alias("own")), "sets")

    def compared(members: DataFrame) -> DataFrame:
        each = members.select("place", "node").join(sets, "node").select("place", "node", "own").repartition("place").sortWithinPartitions("place")
        return each.mapInArrow(linked, "u long, v long").distinct()

    parts = F.ceil(F.sum("n") * 2 / F.lit(CROWDED)).cast("int")
    crowded = tmp.put(places.groupBy(F.col("place").alias("_p")).agg(parts.alias("parts")).where("parts > 2"), "crowded")
    if crowded.isEmpty():
        edges = tmp.put(compared(places), "edges")
    else:
        known = tmp.put(compared(places.join(small(crowded), F.col("place") == F.col("_p"), "left_anti")), "plain_edges")
        edges = _in_parts(tmp, places.join(small(crowded), F.col("place") == F.col("_p")).drop("_p"), known, compared)
    tmp.free()
    if threshold <= 0.8:
        # exact for sets of five, whose majorities say little about subsets of four
        four = nodes.where("n = 4").select(F.col("node").alias("v"))
        edges = edges.unionByName(nodes.where("n = 5").select(F.col("node").alias("u"), F.explode("less").alias("v")).join(four, "v").select("u", "v"))
    roots = tmp.put(components(tmp, edges), "roots")
    of = roots.select(F.col("node").alias("_n"), "root")
    least = nodes.select("node", "first").join(of, F.col("node") == F.col("_n")).groupBy("root").agg(F.min("first").alias("low"))
    of = tmp.put(of.join(least, "root"), "of")
    low = tmp.put(nodes.join(of, F.col("node") == F.col("_n"), "left").select(F.col("node").alias("_n"), F.when(F.col("_n").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "node").alias("component")), "low")
    return rows.join(low, F.col("node") == F.col("_n")).select("doc_id", "text_key", "component_id", "component")
