"""Operator 3: long repeated passages by a logarithmic family of suffix arrays.

A byte goes if a 50-byte string (a window) that covers it also starts in a document with a smaller id.

Sampling. Each window is owned by an anchor, the leftmost of its 16-byte strings of least hash. Equal
windows have equal anchors, so only windows of anchors that occur in two texts can repeat, and only
their segments (the bytes of an anchor's run of windows) travel.

Index. Segments are dealt to shards by anchor. In a shard each batch of segments gets a suffix array: the
starts of its windows, sorted by the 50 bytes that follow. It is merge-scanned against the levels of the
index, block by block; what they do not hold becomes a new level, and levels of equal size class are
merged, so there are at most log2 of the index's size. A level is a store of bytes, sorted positions in
it, and the smallest id that holds each window. `RepeatIndex` keeps its levels as Parquet between calls.

Hot groups. A task sends each anchor once for many documents and each distinct segment once, under its
smallest id; the other holders of that segment lose it whatever the index finds. Shards that are still
far larger than the mean (an anchor whose surroundings vary) are dealt again by whole windows.

Everything travels in packed rows (arrays of one task and one shard in a row), so Spark sorts and copies
few rows; memory is one part of PART bytes of text, one bucket of anchors (of about BUCKET bytes
of text), or one shard (of about SHARD bytes of text).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale.scratch import Scratch, small

LENGTH, ANCHOR = 50, 16
CHUNK = 1 << 18
PART, BUCKET, SHARD = 1 << 23, 1 << 24, 1 << 20
BLOCK = 1 << 16
BATCH_WINDOWS = 1 << 18
#: A shard with more than so many times the mean of windows is dealt again, if it has HEAVY_WINDOWS at least.
HEAVY, HEAVY_WINDOWS = 8, 1 << 19
_BITS = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Packed arrays, of spans that go (shard -1), or of distinct segments with an id and a number of windows (e) each, and
#: for each of their occurrences, `counts` many, the text's tag and the first window (s).
PACKED = "shard int, deal int, docs binary, counts binary, tags binary, s binary, e binary, store binary, windows long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<int>"
LEVEL = "shard int, store binary, pos binary, owner binary, windows long"


# -- anchors -----------------------------------------------------------------------------------------


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of the anchors of texts laid end to end; at most 2**20 bytes."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = data.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    h = v[:-8] * _MUL[0]
    h ^= h >> np.uint64(32)
    h += v[8:] * _MUL[1]
    h ^= h >> np.uint64(29)
    h *= _MUL[2]
    h ^= h >> np.uint64(32)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    span = LENGTH - ANCHOR + 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = (low & _LOW).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    # a window of a short text may reach over it; the loop above marks only the text's own last bytes
    cut = np.flatnonzero((at[1:] != at[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate(([0], cut))
    size = np.diff(np.concatenate((first, [n])))
    ok = inside[first]
    # least hashes are small ones: mixed again, their high bits deal them evenly
    h = h[at[first[ok]]] * _MUL[1]
    return (h ^ (h >> np.uint64(32))) * _MUL[0], first[ok], size[ok]


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's index, hash, first window in the text, number of windows), for some texts or a part of one at a time."""

    def pack(part: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(t for _, t, _ in part), np.uint8)
        ends = np.cumsum([len(t) for _, t, _ in part])
        h, first, size = _runs(data, ends)
        own = np.searchsorted(ends, first, side="right")
        begin = ends - np.array([len(t) for _, t, _ in part])
        return np.array([k for k, _, _ in part])[own], h.view(np.int64), first - begin[own] + np.array([o for _, _, o in part])[own], size

    part, n = [], 0
    for k, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for o in range(0, len(t) - LENGTH + 1, CHUNK):
            piece = t[o : o + CHUNK + LENGTH - 1]
            part.append((k, piece, o))
            n += len(piece)
            if n >= CHUNK:
                yield pack(part)
                part, n = [], 0
    if part:
        yield pack(part)


def _all_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's index in ascending order, hash as uint64, first window, number of windows) of all texts."""
    parts = list(anchors(texts))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, h, first, size = (np.concatenate(c) for c in zip(*parts, strict=True))
    return own, h.view(np.uint64), first, size


# -- packing -----------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as all of them need."""
    if not len(x):
        return b""
    low, high = int(x.min()), int(x.max())
    for t in (np.int8, np.int16, np.int32):
        if np.iinfo(t).min <= low and high <= np.iinfo(t).max:
            return x.astype(t).tobytes()
    return x.astype(np.int64).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"i{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _steps(x: np.ndarray) -> bytes:
    """int64 as the first value and narrow differences; they may wrap around, which the sum undoes."""
    return x[:1].astype(np.int64).tobytes() + _narrow(np.diff(x))


def _sums(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate((np.frombuffer(b[:8], np.int64), _wide(b[8:], n - 1))))


def _six(h: np.ndarray) -> bytes:
    """The low 48 bits; the bucket has the high ones."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _slices(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    if len(key):
        cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])).tolist()
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield int(key[a]), slice(a, z)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] many, and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _deal(x: np.ndarray, deals: int) -> np.ndarray:
    """The deal of ids, a power of two many; _deal_column says the same in Spark."""
    x = x.view(np.uint64)
    for k in (32, 16, 8):
        x = x ^ (x >> np.uint64(k))
    return (x & np.uint64(deals - 1)).astype(np.int64)


def _deal_column(x: Column, deals: int) -> Column:
    for k in (32, 16, 8):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseAND(F.lit(deals - 1)).cast("int")


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    columns = columns or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return _batch([list(c) for c in zip(*rows, strict=True)], schema)


def _span_rows(doc: np.ndarray, tag: np.ndarray, s: np.ndarray, e: np.ndarray, deals: int) -> list[tuple]:
    """Packed rows of spans, overlapping ones of a text merged."""
    if not len(doc):
        return []
    deal = _deal(doc, deals)
    order = np.lexsort((s, tag, doc, deal))
    deal, doc, tag, s, e = (x[order] for x in (deal, doc, tag, s, e))
    s, e, first = _merged(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))), s, e)
    deal, doc, tag = deal[first], doc[first], tag[first]
    return [(-1, d, _steps(doc[at]), None, tag[at].tobytes(), s[at].astype(np.int32).tobytes(), e[at].astype(np.int32).tobytes(), None, 0) for d, at in _slices(deal)]


def _merged(new: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that cover the same places as spans sorted by text and start, and the index of each run's first span; new marks a text's first span."""
    # ends of later texts are made larger than all of those before, so one running maximum serves all texts
    base = (np.cumsum(new) - 1) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + base)
    first = np.flatnonzero(new | np.concatenate(([True], (s + base)[1:] > reach[:-1])))
    last = np.concatenate((first[1:] - 1, [len(s) - 1]))
    return s[first], reach[last] - base[last], first


# -- tasks -------------------------------------------------------------------------------------------

ANCHORS = "bucket int, n int, tokens binary, h binary, docs binary, ks binary"
REPLY = "deal int, n int, docs binary, ks binary"


def _reply_rows(doc: np.ndarray, k: np.ndarray, deals: int) -> list[tuple]:
    deal = _deal(doc, deals)
    order = np.lexsort((doc, deal))
    deal, doc, k = deal[order], doc[order], k[order]
    return [(d, at.stop - at.start, _steps(doc[at]), _narrow(k[at])) for d, at in _slices(deal)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of rows (doc, text), about PART bytes at a time."""
    docs, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            docs.append(d)
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= PART:
                yield np.array(docs, np.int64), texts
                docs, texts, size = [], [], 0
    if texts:
        yield np.array(docs, np.int64), texts


def _ordinals(own: np.ndarray) -> np.ndarray:
    """Each anchor's number within its text."""
    return np.arange(len(own)) - np.searchsorted(own, own)


def _anchor_rows(bits: int):
    """(doc, text) -> anchors by bucket. An anchor that several texts of a part hold is sent once, as a token; its holders are sent as known, in a row of a negative bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, texts in _parts(batches):
            own, h, _, _ = _all_anchors(texts)
            if not len(own):
                continue
            k = _ordinals(own)
            order = np.argsort(h, kind="stable")
            hs, os = h[order], own[order]
            new = np.concatenate(([True], hs[1:] != hs[:-1]))
            pair = new | np.concatenate(([True], os[1:] != os[:-1]))
            group = (np.cumsum(new) - 1)[pair]
            pick = order[pair]
            many = np.bincount(group) > 1
            known = pick[many[group]]
            tokens = hs[new][many]
            away = -1 - int(_deal(doc[own[known[:1]]], 1 << bits)[0]) if len(known) else 0
            rows = [(away, len(known), None, None, _steps(doc[own[known]]), _narrow(k[known]))] if len(known) else []
            one = np.sort(pick[~many[group]])
            where = lambda x: (x >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            b1, b2 = where(h[one]), where(tokens)
            order = np.argsort(b1, kind="stable")
            one, b1 = one[order], b1[order]
            singles, marked = dict(_slices(b1)), dict(_slices(b2))
            for b in singles.keys() | marked.keys():
                at = one[singles.get(b, slice(0, 0))]
                rows.append((b, len(at), _six(tokens[marked.get(b, slice(0, 0))]), _six(h[at]), _steps(doc[own[at]]), _narrow(k[at])))
            yield _rows(rows, ANCHORS)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by the first column, one value's at a time."""
    now, held = None, []
    for b in batches:
        for key, at in _slices(b.column(0).to_numpy()):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(b.slice(at.start, at.stop - at.start))
    if held:
        yield now, held


def _shared(deals: int):
    """Anchors sorted by bucket -> for each text the numbers of its anchors that another text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _grouped(batches):
            docs, ks, tokens, h = [], [], [], []
            for b in held:
                for n, t, x, d, k in zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True):
                    docs.append(_sums(d, n))
                    ks.append(_wide(k, n))
                    tokens.append(t)
                    h.append(x)
            if bucket < 0:
                for d, k in zip(docs, ks, strict=True):
                    yield _rows(_reply_rows(d, k, deals), REPLY)
                continue
            one, more = _from_six(b"".join(h)), _from_six(b"".join(tokens))
            if not len(one):
                continue
            every = np.concatenate((one, more))
            order = np.argsort(every, kind="stable")
            s = every[order]
            same = s[1:] == s[:-1]
            shared = np.zeros(len(every), bool)
            shared[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            shared = shared[: len(one)]
            if shared.any():
                yield _rows(_reply_rows(np.concatenate(docs)[shared], np.concatenate(ks)[shared], deals), REPLY)

    return run


def _dealt(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[tuple]:
    """Rows sorted by deal and kind, the columns of texts last -> (prepared notes of the deal, docs, tags, texts), about PART bytes at a time."""
    deal, notes, ready, part, size = None, [], None, [], 0
    for b in batches:
        n = b.num_columns
        for key, at in _slices(b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()):
            piece = b.slice(at.start, at.stop - at.start)
            if key // 2 != deal:
                if part:
                    yield ready, *map(list, zip(*part, strict=True))
                deal, notes, ready, part, size = key // 2, [], None, [], 0
            if key % 2 == 0:
                notes.append(piece)
                continue
            if ready is None:
                ready, notes = prepare(notes), []
            for d, g, t in zip(piece.column(n - 3).to_pylist(), piece.column(n - 2).to_pylist(), piece.column(n - 1).cast(pa.binary()), strict=True):
                part.append((d, g, t.as_py()))
                size += len(part[-1][2])
                if size >= PART:
                    yield ready, *map(list, zip(*part, strict=True))
                    part, size = [], 0
    if part:
        yield ready, *map(list, zip(*part, strict=True))


class _Segments:
    """Segments of a task, equal ones once."""

    def __init__(self, shard_bits: int, deals: int):
        self.shard_bits, self.deals = shard_bits, deals
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.h: list[np.ndarray] = []
        self.of: list[np.ndarray] = []

    def add(self, docs: np.ndarray, tags: np.ndarray, texts: list[bytes], own, h, first, size) -> None:
        known, ids, before = self.known, [], len(self.known)
        for k, a, n in zip(own.tolist(), first.tolist(), size.tolist(), strict=True):
            ids.append(known.setdefault(texts[k][a : a + n + LENGTH - 1], len(known)))
        ids = np.array(ids, np.int64)
        fresh = ids >= before
        # the first of each new segment, in the order of their numbers
        _, at = np.unique(ids[fresh], return_index=True)
        at = np.flatnonzero(fresh)[at]
        self.h.append(h[at])
        self.size += int((size[at] + LENGTH - 1).sum()) + 40 * len(ids)
        self.of.append(np.stack((ids, docs[own], tags[own], first, size)))

    def rows(self) -> list[tuple]:
        """Each distinct segment under its smallest id, by shard; for all other holders, spans: a smaller id holds the same bytes."""
        if not self.of:
            return []
        ids, doc, tag, first, size = np.concatenate(self.of, axis=1)
        h, texts = np.concatenate(self.h), list(self.known)
        low = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(low, ids, doc)
        late = doc > low[ids]
        out = _span_rows(doc[late], tag[late], first[late], (first + size)[late] + LENGTH - 1, self.deals)
        ids, tag, first, size = (x[~late] for x in (ids, tag, first, size))
        # a segment's occurrences, all of its smallest id, side by side
        order = np.argsort(ids, kind="stable")
        tag, first, of = tag[order], first[order], np.cumsum(counts := np.bincount(ids, minlength=len(texts))) - counts
        long = size[order][of]
        shard = (h >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        order = np.lexsort((low, shard))
        for s, at in _slices(shard[order]):
            o = order[at]
            each = _ranges(of[o], counts[o])
            out.append(_segment_row(s, low[o], counts[o], tag[each], first[each], long[o], b"".join([texts[i] for i in o.tolist()])))
        self.clear()
        return out


def _segment_row(shard: int, doc: np.ndarray, counts: np.ndarray, tag: np.ndarray, first: np.ndarray, size: np.ndarray, store: bytes) -> tuple:
    return shard, 0, _steps(doc), _narrow(counts), tag.tobytes(), first.astype(np.int32).tobytes(), size.astype(np.int32).tobytes(), pa.compress(store, "zstd", asbytes=True), int(size.sum())


def _cut(shard_bits: int, deals: int):
    """Replies and texts by deal -> PACKED: segments of shared anchors."""

    def prepare(notes: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        doc, ks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in notes:
            for n, d, k in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                doc.append(_sums(d, n))
                ks.append(_wide(k, n))
        doc, ks = np.concatenate(doc), np.concatenate(ks)
        order = np.argsort(doc, kind="stable")
        return doc[order], ks[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Segments(shard_bits, deals)
        for (rd, rk), docs, tags, texts in _dealt(batches, prepare):
            lo, hi = np.searchsorted(rd, docs), np.searchsorted(rd, docs, side="right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            texts = [texts[i] for i in some.tolist()]
            docs, tags, lo, hi = np.array(docs, np.int64)[some], np.array(tags, np.int64)[some], lo[some], hi[some]
            own, h, first, size = _all_anchors(texts)
            begin, end = np.searchsorted(own, np.arange(len(texts))), np.searchsorted(own, np.arange(len(texts)), side="right")
            n = hi - lo
            row = np.repeat(np.arange(len(texts)), n)
            at = begin[row] + rk[_ranges(lo, n)]
            # texts of one id share its replies; a number that a text does not have is another text's
            at = at[at < end[row]]
            # an anchor is reported once for a text, and counts wherever it stands there
            mixed = h ^ (own.astype(np.uint64) * _MUL[0])
            keep = np.isin(mixed, mixed[at])
            found.add(docs, tags, texts, own[keep], h[keep], first[keep], size[keep])
            if found.size >= PART:
                yield _rows(found.rows(), PACKED)
        if found.of:
            yield _rows(found.rows(), PACKED)

    return run


# -- suffix arrays -----------------------------------------------------------------------------------


class Level:
    """Windows of a store of bytes as sorted positions, distinct, each with the smallest id that holds it."""

    def __init__(self, store: np.ndarray, pos: np.ndarray, owner: np.ndarray):
        self.store, self.pos, self.owner = store, pos, owner

    def __len__(self) -> int:
        return len(self.pos)

    def keys(self, a: int, z: int) -> np.ndarray:
        return windows(self.store, self.pos[a:z])

    def rank(self, key: bytes, low: int = 0) -> int:
        """Number of windows up to that key, which is after place low."""
        high = len(self.pos)
        while low < high:
            mid = (low + high) // 2
            at = int(self.pos[mid])
            if self.store[at : at + LENGTH].tobytes() <= key:
                low = mid + 1
            else:
                high = mid
        return low

    def key(self, k: int) -> bytes:
        at = int(self.pos[k])
        return self.store[at : at + LENGTH].tobytes()

    def beside(self, other: Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The linear merge of two levels in blocks: (places in self, then in other counted on from len(self)) in the order of their keys, and whether each equals the one before."""
        j = 0
        for i in range(0, max(1, len(self)), BLOCK):
            z = min(i + BLOCK, len(self))
            j2 = other.rank(self.key(z - 1), j) if z < len(self) else len(other)
            both = np.concatenate((self.keys(i, z), other.keys(j, j2)))
            # a stable sort finds the two runs and merges them
            order = np.argsort(both, kind="stable")
            s = both[order]
            place = np.concatenate((np.arange(i, z), len(self) + np.arange(j, j2)))[order]
            yield place, np.concatenate(([False], s[1:] == s[:-1]))
            j = j2

    def compact(self) -> Level:
        """The same without bytes that no window needs."""
        need = np.zeros(len(self.store) + 1, np.int64)
        np.add.at(need, self.pos, 1)
        np.add.at(need, self.pos + LENGTH, -1)
        keep = np.cumsum(need[:-1]) > 0
        if keep.all():
            return self
        to = np.cumsum(keep) - 1
        return Level(self.store[keep], to[self.pos].astype(np.int32), self.owner)


def windows(store: np.ndarray, pos: np.ndarray) -> np.ndarray:
    if not len(pos):
        return np.zeros(0, f"S{LENGTH}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(store, LENGTH)[pos]).view(f"S{LENGTH}").ravel()


def suffix_array(store: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of these windows, and for each of them its place in it."""
    keys = windows(store, pos)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.empty(len(pos), np.int64)
    place[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    return Level(store, pos[order][first].astype(np.int32), low), place


def merge(a: Level, b: Level) -> Level:
    """One level of all windows of two; of equal ones the smaller id."""
    pos, owner = np.concatenate((a.pos.astype(np.int64), b.pos.astype(np.int64) + len(a.store))), np.concatenate((a.owner, b.owner))
    out_pos, out_owner = [], []
    for place, again in a.beside(b):
        first = np.flatnonzero(~again)
        if len(first):
            out_pos.append(pos[place[first]].astype(np.int32))
            out_owner.append(np.minimum.reduceat(owner[place], first))
    join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
    return Level(np.concatenate((a.store, b.store)), join(out_pos, np.int32), join(out_owner, np.int64)).compact()


def merge_scan(batch: Level, levels: list[Level]) -> tuple[np.ndarray, Level]:
    """For each window of the batch the smallest id known to hold it; and a level of what the others do not hold under an id that small."""
    low, known = batch.owner.copy(), np.zeros(len(batch), bool)
    for level in levels:
        for at, again in level.beside(batch):
            hit = np.flatnonzero(again)
            mine, theirs = at[hit] - len(level), at[hit - 1]
            known[mine] |= level.owner[theirs] <= batch.owner[mine]
            low[mine] = np.minimum(low[mine], level.owner[theirs])
    return low, Level(batch.store, batch.pos[~known], batch.owner[~known]).compact()


class Family:
    """Levels whose sizes fall at least by half from one to the next."""

    def __init__(self, levels: list[Level] | None = None) -> None:
        self.levels: list[Level] = levels or []

    def scan(self, store: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smallest id known to hold each window, its own included; then the batch joins the index."""
        batch, place = suffix_array(store, pos, doc)
        low, fresh = merge_scan(batch, self.levels)
        if len(fresh):
            self.levels.append(fresh)
            while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
                b, a = self.levels.pop(), self.levels.pop()
                self.levels.append(merge(a, b))
        return low[place]


def _unpacked(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(doc, counts, tag, s, e, store) of packed rows; spans have no counts and an empty store."""
    docs, counts, tags, s, e, store = [], [], [], [], [], []
    for b in held:
        at = [b.schema.get_field_index(c) for c in ("docs", "counts", "tags", "s", "e", "store")]
        for d, c, g, x, y, t in zip(*(b.column(k).to_pylist() for k in at), strict=True):
            n = len(y) // 4
            docs.append(_sums(d, n))
            counts.append(_wide(c or b"", n if c else 0))
            tags.append(g)
            s.append(x)
            e.append(y)
            store.append(pa.decompress(t, int((_wide(y, n) + LENGTH - 1).sum()), "zstd", asbytes=True) if t else b"")
    wide = lambda x: np.frombuffer(b"".join(x), np.int32).astype(np.int64)
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return join(docs), join(counts), np.frombuffer(b"".join(tags), np.int64), wide(s), wide(e), np.frombuffer(b"".join(store), np.uint8)


class _Shard:
    """The segments of packed rows, and what is found out about their windows."""

    def __init__(self, held: list[pa.RecordBatch]):
        self.doc, self.counts, self.tag, self.first, self.size, self.store = _unpacked(held)
        self.at = np.cumsum(self.counts) - self.counts
        self.off = np.cumsum(self.size + LENGTH - 1) - (self.size + LENGTH - 1)

    def windows(self, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, number in it) of all windows of these segments."""
        n = self.size[o]
        return np.repeat(o, n), _ranges(np.zeros(len(o), np.int64), n)

    def batches(self, family: Family) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs the segments through the family in the order of their ids: (segment, number, smallest id known) of each batch's windows."""
        order = np.argsort(self.doc, kind="stable")
        for _, at in _slices(np.cumsum(self.size[order]) // BATCH_WINDOWS):
            o = order[at]
            row, k = self.windows(o)
            # the batch's own bytes only, so that a level does not hold on to the shard's
            long = self.size[o] + LENGTH - 1
            begin = np.zeros(len(self.size), np.int64)
            begin[o] = np.cumsum(long) - long
            yield row, k, family.scan(self.store[_ranges(self.off[o], long)], begin[row] + k, self.doc[row])

    def gone(self, row: np.ndarray, k: np.ndarray, low: np.ndarray, deals: int) -> list[tuple]:
        """Packed spans of windows that a smaller id holds, for all occurrences of their segments."""
        gone = low < self.doc[row]
        turn = row[1:] != row[:-1]
        starts = np.flatnonzero(gone & np.concatenate(([True], ~gone[:-1] | turn)))
        stops = np.flatnonzero(gone & np.concatenate((~gone[1:] | turn, [True])))
        r = row[starts]
        n = self.counts[r]
        each = _ranges(self.at[r], n)
        s, e = (np.repeat(k[x], n) + self.first[each] for x in (starts, stops))
        return _span_rows(np.repeat(self.doc[r], n), self.tag[each], s, e + LENGTH, deals)


def _index(deals: int):
    """Segments sorted by shard -> spans that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches):
            shard = _Shard(held)
            for row, k, low in shard.batches(Family()):
                if rows := shard.gone(row, k, low, deals):
                    yield _rows(rows, PACKED)

    return run


def _split(shards: int, deals: int):
    """Segments of heavy shards -> single windows, distinct in a row, dealt by all their bytes; and spans of those that a smaller id of the row holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own = _Shard([b.slice(r, 1)])
                for row, k, low in own.batches(Family()):
                    rows = own.gone(row, k, low, deals)
                    keep = low == own.doc[row]
                    row, k = row[keep], k[keep]
                    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own.store, LENGTH)[own.off[row] + k])
                    h = np.zeros(len(row), np.uint64)
                    for c in range(0, LENGTH, 8):
                        part = np.zeros((len(row), 8), np.uint8)
                        part[:, : min(8, LENGTH - c)] = w[:, c : c + 8]
                        h = (h ^ part.view(np.uint64).ravel()) * _MUL[0]
                        h ^= h >> np.uint64(31)
                    shard = shards + (h % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    for s, x in _slices(shard[order]):
                        o = order[x]
                        n = own.counts[row[o]]
                        each = _ranges(own.at[row[o]], n)
                        rows.append(_segment_row(s, own.doc[row[o]], n, own.tag[each], own.first[each] + np.repeat(k[o], n), np.ones(len(o), np.int64), w[o].tobytes()))
                    yield _rows(rows, PACKED)

    return run


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and texts by deal -> RESULT."""

    def prepare(notes: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        doc, _, tag, s, e, _ = _unpacked(notes)
        order = np.lexsort((s, tag, doc))
        return doc[order], tag[order], s[order], e[order]

    for (rd, rt, rs, re), docs, tags, texts in _dealt(batches, prepare):
        rows = []
        for d, g, t in zip(docs, tags, texts, strict=True):
            s = e = np.zeros(0, np.int64)
            if d is not None and len(rd):
                a, z = np.searchsorted(rd, d), np.searchsorted(rd, d, side="right")
                mine = np.flatnonzero(rt[a:z] == g) + a
                if len(mine):
                    s, e, _ = _merged(np.arange(len(mine)) == 0, rs[mine], re[mine])
            s, e = s.tolist(), e.tolist()
            kept = b"".join([t[a:z] for a, z in zip([0, *e], [*s, len(t)], strict=True)])
            rows.append((d, len(t), sum(e) - sum(s), len(s), hashlib.sha256(kept).hexdigest(), [x for r in zip(s, e, strict=True) for x in r]))
        yield _rows(rows, RESULT)


# -- the operator ------------------------------------------------------------------------------------


def _power(x: float, low: int, high: int) -> int:
    """Bits of the power of two that is not under x, within bounds."""
    return int(min(high, max(low, np.ceil(np.log2(max(1.0, x))))))


def _texts(tmp: Scratch, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(doc, tag, text), and all bytes. The tag tells several texts of one id apart; elsewhere it is 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), t.alias("text"))
    facts = rows.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("z"), F.sum(F.octet_length("text").cast("long")).alias("n"))
    facts = tmp.put(facts.groupBy((F.col("a") < F.col("z")).alias("many"), F.when(F.col("a") < F.col("z"), F.col("doc")).alias("id")).agg(F.sum("n").alias("n")), "facts")
    size = facts.agg(F.sum("n")).first()[0] or 0
    many = facts.where("many and id is not null").select(F.col("id").alias("_i"))
    if many.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("tag"), "text"), size
    tagged = rows.join(small(many), F.col("doc") == F.col("_i"), "left")
    return tagged.select("doc", F.when(F.col("_i").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long").alias("tag"), "text"), size


def _with_notes(notes: DataFrame, texts: DataFrame, deals: int) -> DataFrame:
    """Notes (deal, ...) and texts side by side: each deal's notes first, then its texts."""
    own = texts.select(_deal_column(F.coalesce("doc", F.xxhash64("text")), deals).alias("deal"), F.lit(1).alias("kind"), "doc", "tag", "text")
    both = notes.withColumn("kind", F.lit(0)).unionByName(own, allowMissingColumns=True)
    names = [c for c in notes.columns if c != "deal"]
    return both.select("deal", "kind", *names, "doc", "tag", "text").repartition("deal").sortWithinPartitions("deal", "kind")


def _spans(tmp: Scratch, packed: DataFrame, shards: int, deals: int) -> DataFrame:
    """Written PACKED rows -> spans that go."""
    sizes = packed.where("shard >= 0").groupBy("shard").agg(F.sum("windows").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # of these there are shards / HEAVY at most
    heavy = [r.shard for r in sizes.where(F.col("n") > max(HEAVY * total / shards, HEAVY_WINDOWS)).select("shard").collect()]
    rows, done = packed.where("shard >= 0"), packed.where("shard < 0")
    if heavy:
        again = rows.where(F.col("shard").isin(heavy)).mapInArrow(_split(shards, deals), PACKED)
        again = tmp.put(again, "split")
        rows = rows.where(~F.col("shard").isin(heavy)).unionByName(again.where("shard >= 0"))
        done = done.unionByName(again.where("shard < 0"))
    return done.unionByName(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_index(deals), PACKED))



def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs) for every row; runs: starts and ends, in turn, of what goes.

    Null texts are empty. Rows without an id are neither sources nor lose anything. Equal ids are no
    smaller than each other, whatever their texts, so repeated rows keep what smaller ids do not hold.
    Texts under 50 bytes stay. Extra columns are not read. An empty table gives an empty result.
    """
    tmp = Scratch(docs.sparkSession)
    texts, size = _texts(tmp, docs, doc_id, text)
    known = texts.where("doc is not null")
    bits, shard_bits, deals = _power(size / BUCKET, 8, 22), _power(size / SHARD, 8, 22), 1 << _power(size / BUCKET / 2, 6, 20)
    rows = known.select("doc", "text").mapInArrow(_anchor_rows(bits), ANCHORS)
    replies = tmp.put(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(deals), REPLY), "replies")
    tmp.free()  # of the anchors' shuffle
    packed = tmp.put(_with_notes(replies, known, deals).mapInArrow(_cut(shard_bits, deals), PACKED), "packed")
    tmp.drop("replies")
    spans = tmp.put(_spans(tmp, packed, 1 << shard_bits, deals).select("deal", "docs", "counts", "tags", "s", "e", "store"), "spans")
    tmp.drop("packed", "split")
    return _with_notes(spans, texts, deals).mapInArrow(_rest, RESULT)


# -- an index that lasts -----------------------------------------------------------------------------


def _every(bits: int, deals: int):
    """(doc, tag, text) -> PACKED: segments of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Segments(bits, deals)
        for b in batches:
            docs, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                found.add(docs[at:], tags[at:], part, *_all_anchors(part))
                if found.size >= PART:
                    yield _rows(found.rows(), PACKED)
        if found.of:
            yield _rows(found.rows(), PACKED)

    return run


def _level_row(shard: int, x: Level) -> tuple:
    return shard, x.store.tobytes(), x.pos.tobytes(), x.owner.tobytes(), len(x)


def _levels(held: list[pa.RecordBatch]) -> list[Level]:
    out = []
    for b in held:
        at = [b.schema.get_field_index(c) for c in ("store", "pos", "owner")]
        for s, p, o in zip(*(b.column(c).to_pylist() for c in at), strict=True):
            if p is not None:
                out.append(Level(np.frombuffer(s, np.uint8), np.frombuffer(p, np.int32), np.frombuffer(o, np.int64)))
    return out


EXTENDED = f"{PACKED}, pos binary, owner binary"


def _extend(deals: int):
    """A batch's segments and the levels of the index, sorted by shard -> spans that go, and the rows of a new level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _grouped(batches):
            levels = _levels(held)
            own = _Shard([b.filter(b.column(b.schema.get_field_index("pos")).is_null()) for b in held])
            row, k = own.windows(np.arange(len(own.size)))
            batch, place = suffix_array(own.store, own.off[row] + k, own.doc[row])
            low, fresh = merge_scan(batch, levels)
            rows = [(*r, None, None) for r in own.gone(row, k, low[place], deals)]
            if len(fresh):
                s, text, pos, owner, size = _level_row(shard, fresh)
                rows.append((s, 0, None, None, None, None, None, text, size, pos, owner))
            yield _rows(rows, EXTENDED)

    return run


def _join_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, held in _grouped(batches):
        levels = _levels(held)
        while len(levels) > 1:
            levels.append(merge(levels.pop(), levels.pop()))
        yield _rows([_level_row(shard, x) for x in levels], LEVEL)


class RepeatIndex:
    """A logarithmic family that outlasts a call: levels as Parquet under a shared path, found by a manifest.

    Unlike `remove_repeats`, which knows the whole table, it keeps all anchors' segments, because a later
    batch may hold any of them. A shard of all levels must fit a task; `shard_bits` is fixed when the
    index is made. The manifest is written last, so a call that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, shard_bits: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: hadoop(f"{self.path}/{name}")
        self._fs = self._at("manifest").getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.levels, self.shard_bits = 0, [], shard_bits
        if self._fs.exists(self._at("manifest")):
            done = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest")) if self._fs.exists(self._at(f"manifest/{s.getPath().getName()}/_SUCCESS"))]
            self.version = max((int(n[2:]) for n in done), default=0)
            if self.version:
                kept = json.loads(spark.read.text(f"{self.path}/manifest/v={self.version}").first()[0])
                self.levels, self.shard_bits = [tuple(x) for x in kept["levels"]], kept["shard_bits"]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(*[f"{self.path}/{n}" for n in names])

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = f"level-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name, self._read([name]).agg(F.sum("windows")).first()[0] or 0

    def add(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """What remove_repeats returns for these rows, judged against all batches so far and themselves; then they are part of the index.

        Results of earlier batches stay as they were, also where this one has smaller ids.
        """
        tmp = Scratch(self.spark)
        texts, size = _texts(tmp, docs, doc_id, text)
        deals = 1 << _power(size / BUCKET / 2, 6, 20)
        packed = tmp.put(texts.where("doc is not null").mapInArrow(_every(self.shard_bits, deals), PACKED), "packed")
        rows = packed.where("shard >= 0")
        if self.levels:
            rows = rows.unionByName(self._read([n for n, _ in self.levels]), allowMissingColumns=True)
        rows = rows.select(*[c.split()[0] for c in PACKED.split(", ")], *(["pos", "owner"] if self.levels else [F.lit(None).cast("binary").alias(c) for c in ("pos", "owner")]))
        made = tmp.put(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_extend(deals), EXTENDED), "made")
        levels = [*self.levels, self._write(made.where("pos is not null").select(*[c.split()[0] for c in LEVEL.split(", ")]))]
        old = []
        while len(levels) > 1 and levels[-2][1].bit_length() <= levels[-1][1].bit_length():
            pair = [levels.pop()[0], levels.pop()[0]]
            old += pair
            levels.append(self._write(self._read(pair).repartition("shard").sortWithinPartitions("shard").mapInArrow(_join_levels, LEVEL)))
        self.version, self.levels = self.version + 1, levels
        kept = json.dumps({"levels": levels, "shard_bits": self.shard_bits})
        self.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v={self.version}")
        for name in old:
            self._fs.delete(self._at(name), True)
        spans = packed.where("shard < 0").unionByName(made.where("pos is null").drop("pos", "owner")).select("deal", "docs", "counts", "tags", "s", "e", "store")
        return _with_notes(spans, texts, deals).mapInArrow(_rest, RESULT)
