"""Operator 5 at larger distances: SimHash fingerprints on rings of eight segments, for candidates.

A set's 64 independent fingerprints of 64 bits are cut into eight segments of 8 on a ring. If two
fingerprints differ in at most 7 bits, then from some segment on, every chain of l consecutive segments
differs in at most floor(l * 7 / 8) bits: 0, 1, ..., 7. The chain of three needs its first segment equal, at
most one differing bit in the second and two in both; of the four half bytes of these two segments, some
pair that includes one of the second is then equal. So each start gives five keys of 16 equal bits. Within a
key's group the chain of four is checked first, then all chains. No pair within 7 bits is lost.

Two sets at Jaccard similarity 0.8 have cosine 0.889; a bit differs with chance 0.152 and one fingerprint in
at most 7 of 64 with chance 0.22. All 64 miss with chance 1.3e-7, closer pairs with less. Short sets differ
from that, as majorities tie: 6.6e-6 at worst (sets of 12 and 15), but for sets of four and five. Those are
found exactly, by leaving each element out (`short`).

A task has a print of all sets, up to HELD of them; with more, one start and a share of its segment's values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscale.scratch import Scratch

PRINTS, BITS, DISTANCE, SEGMENTS = 64, 64, 7, 8
#: Prints whose shuffles are on disk together, and most sets that one task takes whole.
ROUND, HELD = 16, 1 << 21
#: Groups of more fingerprints are searched from pivots, which is fast where many are alike.
PAIRS_UP_TO = 512
_BLOCK = 255
_ODD = np.array([(2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for j in range(PRINTS)], np.uint64)
_LOW = np.uint64(0x0101010101010101)
#: The pairs of equal half bytes of the second and third segment that make the five keys of a start.
_EQUAL = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def prints(own: np.ndarray) -> np.ndarray:
    """Signed 64-bit SimHashes of a set of hashes, zeros for none; of each bit, whether over half of the mixed hashes have it."""
    ones = np.zeros((PRINTS, 8, 8), np.int64)
    for at in range(0, len(own), _BLOCK):
        h = own[at : at + _BLOCK, None]
        x = (h ^ (h >> np.uint64(31))) * _ODD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        # 255 rows fit into the eight counters of a word
        for k in range(8):
            ones[:, :, k] += ((x >> np.uint64(k)) & _LOW).sum(0, dtype=np.uint64).view(np.uint8).reshape(PRINTS, 8)
    return np.packbits((2 * ones > len(own)).reshape(PRINTS, BITS), axis=1, bitorder="little").view(np.int64).ravel()


def short(own: np.ndarray) -> np.ndarray:
    """Of a set of five, the numbers of its subsets of four."""
    if len(own) != 5:
        return np.zeros(0, np.int64)
    return np.array([set_number(np.delete(own, k)) for k in range(5)], np.uint64).view(np.int64)


def set_number(own: np.ndarray) -> int:
    """The number that stands for a set of sorted hashes."""
    return xxhash.xxh64_intdigest(own.tobytes(), 1)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of each group of rows with equal first column, of which batches are sorted."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            part = b.slice(a, z - a)
            # the last group may go on in the next batch
            if rest and rest[-1].column(0)[0] != part.column(0)[0]:
                yield [pa.concat_arrays(c) for c in zip(*(r.columns for r in rest), strict=True)]
                rest = []
            rest.append(part)
    if rest:
        yield [pa.concat_arrays(c) for c in zip(*(r.columns for r in rest), strict=True)]


def _turned(fp: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that the segment `start` comes first."""
    return fp if not start else (fp >> np.uint64(8 * start)) | (fp << np.uint64(BITS - 8 * start))


def _key(x: np.ndarray, equal: tuple[int, int]) -> np.ndarray:
    """Of turned fingerprints: the first segment and two half bytes of the next two."""
    a, b = ((x >> np.uint64(8 + 4 * k)) & np.uint64(15) for k in equal)
    return ((x & np.uint64(255)) | (a << np.uint64(8)) | (b << np.uint64(12))).astype(np.uint16)


def _within(x: np.ndarray) -> np.ndarray:
    """Whether differences of turned fingerprints keep the budgets of all chains from the first segment; the last chain is the full distance."""
    ok = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 4 * DISTANCE // SEGMENTS
    at = np.flatnonzero(ok)
    for n in range(1, SEGMENTS + 1):
        at = at[np.bitwise_count(x[at] & np.uint64((1 << 8 * n) - 1)) <= n * DISTANCE // SEGMENTS]
    ok[:] = False
    ok[at] = True
    return ok


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest labels after u and v are linked."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _crowd(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect turned fingerprints of one key just as all their pairs would. Whoever is linked is not compared again."""
    left, u, v, ahead = np.arange(len(x)), [], [], []
    while len(left):
        if ahead:
            i = ahead.pop()
        else:
            i, left = int(left[0]), left[1:]
        near = _within(x[left] ^ x[i])
        hit = left[near].tolist()
        u += [i] * len(hit)
        v += hit
        ahead += hit
        left = left[~near]
    return u, v


def forest(fps: np.ndarray, starts: range | list[int]) -> np.ndarray:
    """For distinct fingerprints: each one's smallest linked index, by any number of links within chains from these starts."""
    n = len(fps)
    label = np.arange(n)
    for start in starts:
        turned = _turned(fps, start)
        for equal in _EQUAL:
            key = _key(turned, equal)
            order = np.argsort(key, kind="stable")
            key, x = key[order], turned[order]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            length = np.diff(cut)
            u, v = [], []
            for a, z in zip(cut[:-1][length > PAIRS_UP_TO].tolist(), cut[1:][length > PAIRS_UP_TO].tolist(), strict=True):
                own = label[order[a:z]]
                if (own != own[0]).any():
                    i, j = _crowd(x[a:z])
                    u.append(order[a:z][i])
                    v.append(order[a:z][j])
            # all pairs of the other groups, by their distance in the order; end: of each row's group
            some = (length > 1) & (length <= PAIRS_UP_TO)
            end = np.repeat(np.where(some, cut[1:], 0), length)
            at, off = np.flatnonzero(end), 1
            while len(at := at[at + off < end[at]]):
                ok = at[_within(x[at] ^ x[at + off])]
                if len(ok):
                    u.append(order[ok])
                    v.append(order[ok + off])
                off += 1
            if u:
                label = _joined(label, np.concatenate(u), np.concatenate(v))
    return label


def _linked(whole: bool):
    """Rows (deal, fp, node) sorted by deal -> (deal, node, root): nodes that are linked to others there, and a node that stands for what they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal, fp, node in groups(batches):
            node = node.to_numpy()
            own, first, of = np.unique(fp.to_numpy().view(np.uint64), return_index=True, return_inverse=True)
            root = forest(own, range(SEGMENTS) if whole else [deal[0].as_py() >> 8 & 7])[of]
            many = np.bincount(root, minlength=len(own))[root] > 1
            n = int(many.sum())
            yield pa.RecordBatch.from_arrays([deal.slice(0, n), pa.array(node[many]), pa.array(node[first[root[many]]])], ["deal", "node", "root"])

    return run


def candidates(tmp: Scratch, nodes: DataFrame) -> DataFrame:
    """Written nodes (node, fps) -> (deal, node, root): for each print, or part of one, the groups of nodes that links of at most 7 differing bits connect. A deal's root names the group."""
    n, found = nodes.count(), None
    for first in range(0, PRINTS, ROUND):
        each = nodes.select("node", F.posexplode(F.slice("fps", first + 1, ROUND)).alias("which", "fp"))
        deal = (F.col("which") + first).cast("long") * F.lit(SEGMENTS << 8)
        if n > HELD:
            each = each.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(SEGMENTS)])))
            segment = F.expr("shiftrightunsigned(fp, 8 * start) & 255L")
            deal += F.col("start") * 256 + segment % min(256, math.ceil(n / HELD))
        keyed = each.select(deal.alias("deal"), "fp", "node").repartition("deal").sortWithinPartitions("deal")
        part = tmp.put(keyed.mapInArrow(_linked(n <= HELD), "deal long, node long, root long"), f"ring{first}")
        tmp.free()  # of this round's shuffle
        found = part if found is None else found.unionByName(part)
    return found
