"""Operator 5: SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into four segments of 16 on a ring. If two fingerprints differ in at
most 3 bits, then from some segment on, every chain of l consecutive segments differs in at most
floor(l * 3 / 4) bits: 0, 1, 2, 3. That is turned into equi-join keys without loss. The chain of three
needs its first segment equal, at most one differing bit in the second and two in both; of the four
bytes of these two segments, some pair that includes a byte of the second is then equal. So each start
gives five keys of 32 equal bits, 20 for a fingerprint. Inside a key's group the chain's budgets are
checked first and only then all 64 bits.

Equal fingerprints are one node, so copies never meet as pairs. A group emits a spanning forest, not
its pairs; groups of more than a few thousand fingerprints are searched by flipping up to three of the 48
bits outside the start's segment. Of the 18,472 such differences the budgets leave 11,472, each one binary
search in the group for every fingerprint. Components come from distributed rounds.

A key that a sample of the fingerprints shows to be shared by more than CROWDED of them is made finer, without
loss: of the four bytes that it leaves free, three differing bits leave one equal. So a task's group agrees
in 40 bits, which at most 2 ** 24 fingerprints do, however many documents there are.

One fingerprint finds a near copy only if chance keeps all but 3 bits. `prints` asks for several
independent ones from the same shingles; documents link if any of their fingerprints do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.llm import jaccard
from hopscale.llm.text import free, without
from hopscale.operators.components import components
from hopscale.scratch import Scratch, small

BITS, DISTANCE, SEGMENTS = 64, 3, 4
PAIRS_UP_TO, _ROWS = 4096, 256
#: Keys of more fingerprints are made finer; they are found in every _SAMPLED-th fingerprint.
CROWDED, _SAMPLED = 1 << 20, 64
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int, prints: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of a text's word shingles; zeros without words. The first is by XXH64 with seed 42, the others by its multiples."""
    words = text.lower().split()
    if not words:
        return [0] * prints
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    ones = np.zeros((prints, BITS), np.int64)
    for at in range(0, len(spans), _BLOCK):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans[at : at + _BLOCK]], np.uint64)
        for j in range(prints):
            x = h
            if j:
                x = (h ^ (h >> np.uint64(31))) * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            ones[j] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(spans), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprints(docs: DataFrame, shingle: int, prints: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, fps) for every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle, prints) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "text_key", "fps"])

    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("text")).mapInArrow(run, "doc_id long, text_key long, fps array<long>")


KEYS = 20
#: The pairs of equal bytes that make the five keys of a start, of the bytes of its next two segments.
_EQUAL = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def _segment(fp: Column, j: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (j % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _byte(fp: Column, j: int, k: int) -> Column:
    return F.shiftright(_segment(fp, j), 8 * k).bitwiseAND(F.lit(0xFF))


def _keys(fp: Column, which: Column) -> Column:
    """array<long> of the 20 keys of fingerprint number `which`; the number of the key is above its 32 bits."""
    out = []
    for i in range(SEGMENTS):
        parts = [_byte(fp, i + 1 + k // 2, k % 2) for k in range(4)]
        for a, b in _EQUAL:
            out.append((which * KEYS + len(out)).cast("long") * F.lit(1 << 32) + F.shiftleft(_segment(fp, i), 16) + F.shiftleft(parts[a], 8) + parts[b])
    return F.array(*out)


def _finer(fp: Column, key: Column) -> Column:
    """array<long> of four keys that stand for one: each adds one of the four bytes that the key leaves free, from bit 48 on."""
    each = []
    for i in range(SEGMENTS):
        parts = [(i + 1 + k // 2, k % 2) for k in range(4)]
        for equal in _EQUAL:
            open_ = [x for k, x in enumerate(parts) if k not in equal] + [(i + 3, 0), (i + 3, 1)]
            each.append(F.array(*[key + F.shiftleft((_byte(fp, *x) + (256 * q + 1)).cast("long"), 48) for q, x in enumerate(open_)]))
    return F.get(F.array(*each), (F.shiftright(key, 32) % KEYS).cast("int"))


def _split(tmp: Scratch, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """keyed (key, fp, node) with finer keys instead of the crowded ones. The sample only says where; all rows stay."""
    if nodes.count() <= CROWDED:
        return keyed
    seen = keyed.where(F.pmod(F.xxhash64("node"), F.lit(_SAMPLED)) == 0).groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"))
    crowded = tmp.put(seen.where(F.col("n") * 2 * _SAMPLED > CROWDED).select("_key"), "crowded")
    if crowded.isEmpty():
        return keyed
    marked = keyed.join(small(crowded), F.col("key") == F.col("_key"), "left")
    one = marked.where("_key is null").select("key", "fp", "node")
    return one.unionByName(marked.where("_key is not null").select(F.explode(_finer(F.col("fp"), F.col("key"))).alias("key"), "fp", "node"))


def _within(x: np.ndarray, start: int) -> np.ndarray:
    """Whether differences x keep the budgets of all chains from that start; the last chain is the full distance."""
    ok, mask = np.ones(x.shape, bool), 0
    for step in range(SEGMENTS):
        mask |= 0xFFFF << (16 * ((start + step) % SEGMENTS))
        ok &= np.bitwise_count(x & np.uint64(mask)) <= (step + 1) * DISTANCE // SEGMENTS
    return ok


_FLIPS: dict[int, np.ndarray] = {}


def _flips(start: int) -> np.ndarray:
    """All differences of one to three bits that keep the budgets of the chains from that start, worked out once a task."""
    if start in _FLIPS:
        return _FLIPS[start]
    own = [x for j in range(SEGMENTS) if j != start for x in range(16 * j, 16 * j + 16)]
    m = np.array([sum(1 << x for x in bits) for size in range(1, DISTANCE + 1) for bits in combinations(own, size)], np.uint64)
    _FLIPS[start] = m[_within(m, start)]
    return _FLIPS[start]


def _forest(fps: np.ndarray, start: int) -> np.ndarray:
    """For distinct sorted fingerprints of one key: each one's smallest linked index, by any number of links. Memory grows with their number only."""
    n = len(fps)
    label = np.arange(n)
    while True:
        was = label.copy()
        if n <= PAIRS_UP_TO:
            for i in range(0, n, _ROWS):
                near = _within(fps[i : i + _ROWS, None] ^ fps[None, :], start)
                label[i : i + _ROWS] = np.where(near, label, n).min(1)
        else:
            for m in _flips(start):
                other = fps ^ m
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                hit = fps[at] == other
                label[hit] = np.minimum(label[hit], label[at[hit]])
        label = label[label]
        if (label == was).all():
            return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key -> edges (u, v) between nodes within each key's group."""

    def edges(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
        length = np.diff(cut)
        start_of = (key >> 32 & 0xFFFF) % KEYS // 5
        two = cut[:-1][length == 2]
        u, v = [], []
        if len(two):
            x = fp[two] ^ fp[two + 1]
            for s in range(SEGMENTS):
                ok = two[(start_of[two] == s) & _within(x, s)]
                u.append(node[ok])
                v.append(node[ok + 1])
        for at, n in zip(cut[:-1][length > 2].tolist(), length[length > 2].tolist(), strict=True):
            own, first, of = np.unique(fp[at : at + n], return_index=True, return_inverse=True)
            root = node[at : at + n][first[_forest(own, int(start_of[at]))]][of]
            far = root != node[at : at + n]
            u.append(node[at : at + n][far])
            v.append(root[far])
        join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(join(u)), pa.array(join(v))], ["u", "v"])

    rest: list[tuple[np.ndarray, ...]] = []
    joined = lambda: [np.concatenate(c) for c in zip(*rest, strict=True)]
    for b in batches:
        key, fp, node = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
        if not len(key):
            continue
        # the last group may go on in the next batch
        last = int(np.searchsorted(key, key[-1]))
        if rest and last == 0 and rest[-1][0][-1] == key[-1]:
            rest.append((key, fp, node))
            continue
        rest.append((key[:last], fp[:last], node[:last]))
        yield edges(*joined())
        rest = [(key[last:], fp[last:], node[last:])]
    if rest:
        yield edges(*joined())


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, prints: int = 1, tmp: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, fps, component_id, component) for every row of docs; fps: its fingerprints, component: a number.

    component_id is the smallest id that links of at most 3 differing bits reach. A null or wordless
    text has fingerprint 0 and links like any other. Rows with a null id take part; only if a whole
    component has no id is its component_id null. Repeated rows share a fingerprint. Extra columns are
    not read. An empty table gives an empty result.
    """
    tmp = tmp or Scratch(docs.sparkSession)
    rows = tmp.put(fingerprints(docs, shingle, prints, doc_id, text), "prints")
    # equal fingerprints are one node; its number is fixed by being written
    nodes = rows.groupBy("fps").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id())
    nodes = tmp.put(nodes, "nodes")
    each = nodes.select("node", F.posexplode("fps").alias("which", "fp"))
    keyed = _split(tmp, nodes, each.select(F.explode(_keys(F.col("fp"), F.col("which"))).alias("key"), "fp", "node"))
    keyed = keyed.repartition("key").sortWithinPartitions("key", "fp")
    edges = tmp.put(keyed.mapInArrow(_links, "u long, v long").distinct(), "edges")
    tmp.free()  # of the keys' shuffle
    roots = components(tmp, edges)
    linked = tmp.put(nodes.select("node", "first").join(roots, "node"), "linked")
    least = tmp.put(linked.groupBy("root").agg(F.min("first").alias("low")), "least")
    linked = linked.join(least, "root").select(F.col("node").alias("_n"), "root", "low")
    ids = nodes.join(linked, F.col("node") == F.col("_n"), "left")
    ids = tmp.put(ids.select(F.col("fps").alias("_fps"), F.when(F.col("_n").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "node").alias("component")), "ids")
    return rows.join(ids, F.col("fps") == F.col("_fps")).drop("_fps")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, prints: int = 1, threshold: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the smallest id (of repeated rows, one). All columns stay, whatever their names.

    With a threshold, links are pairs of at least that Jaccard similarity: fingerprints of the sets of shingles
    and pigeonring chains at a distance of 7 find them (hopscale.llm.rings), and an exact comparison follows
    (hopscale.llm.jaccard). Their number is fixed there, so prints is not used then.
    """
    tmp = Scratch(docs.sparkSession)
    if threshold is None:
        found = near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, prints=prints, tmp=tmp)
    else:
        found = jaccard.near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, threshold=threshold, tmp=tmp)
    found = tmp.put(found, "found")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = found.select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"), "component", first.alias("first"))
    # components whose smallest id has several rows
    tie = tmp.put(rows.where("first").groupBy("component").agg(F.count("*").alias("n"), F.min("_k").alias("low")).where("n > 1").select(F.col("component").alias("_c"), "low"), "ties")
    tied = tmp.put(rows.where("first").join(tie, F.col("component") == F.col("_c")).select("_i", "_k", (F.col("_k") == F.col("low")).alias("pick")).distinct(), "tied")
    gone = tmp.put(rows.where("not first").select("_i", "_k").unionByName(tied.select("_i", "_k")).distinct(), "gone")
    tmp.free()
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    left = without(docs, gone, doc_id, text)
    if tied.isEmpty():
        return left
    i, k, own = free("_i", docs), free("_k", docs), free("_key", docs)
    pick = tied.where("pick").select(F.col("_i").alias(i), F.col("_k").alias(k))
    some = docs.withColumn(own, key).join(pick, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), "left_semi")
    return left.unionByName(some.dropDuplicates([doc_id, own]).drop(own))
