"""The ten operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hopscale.llm import chat, decontaminate, licenses, mixing, quality_model, quality_rules, sharding, simhash, suffixes, warc
from hopscale.llm.text import n_space_words, space_words

WORDS = "the of and wood river stone cloud märz été 東京 lamp green under license mit apache version 2 cc by nc".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def nasty(seed=0, n=60):
    """(doc_id, text, lang, source, and columns named like what operators make)."""
    r = random.Random(seed)
    base = [sentence(r, r.randint(1, 60)) + r.choice([".", "", "\n", "!\n", "\t\t"]) for _ in range(n)]
    texts = base + base[:9] + [f"{t} {sentence(r, 2)}" for t in base[5:25]] + ["", None, " \n\t ", "x", sentence(r, 3000)]
    rows = [(k, t, r.choice(["en", None]), r.choice(["a", "a", "b", "ä", None])) for k, t in enumerate(texts)]
    rows += [rows[3], rows[7], (2, "another text for an id that is taken", "en", "a"), (None, base[4], "en", "b"), (None, None, None, None)]
    return [(*x, 7, "z", 1.5) for x in rows]


SCHEMA = "doc_id long, text string, lang string, source string, size int, _row string, _t double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]


def tuples(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_words(spark):
    rows = [(t,) for t in ["a b", "  a b c \x1c d\x0b", "", None, "\n"]]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(space_words("t").alias("w")).collect()]
    assert got == [split_words(t) for (t,) in rows]


# -- 1 ---------------------------------------------------------------------------------------------


def waterfill(caps, weights, budget):
    out, free = [0.0] * len(caps), [i for i in range(len(caps)) if weights[i] > 0]
    while free:
        level = (budget - sum(out)) / sum(weights[i] for i in free)
        full = [i for i in free if caps[i] <= level * weights[i]]
        if not full:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            free.remove(i)
    return out


def test_mixing(spark, docs, none):
    sized = docs.withColumn("size", n_space_words("text"))
    mixed = mixing.mix_sources(sized)
    rows = mixed.collect()
    assert mixed.columns == [*sized.columns, "_mix"] and len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        assert r.size == len(split_words(r.text)) and r._mix.taken in (0, r.size, 2 * r.size) and r._mix.taken == r._mix.copies * r.size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = dict(zip(names, waterfill([2.0 * sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values())), strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r._mix.source_size == sizes[r.source] and r._mix.target == pytest.approx(targets[r.source])
        taken[r.source] += r._mix.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in names)
    again = mixing.mix_sources(sized.repartition(7))
    one = lambda df: Counter((r.doc_id, r.source, r.size, r._mix.taken) for r in df.collect())
    assert one(mixed) == one(again)
    assert mixing.expand(mixed).count() == sum(r._mix.copies for r in rows)
    assert mixing.mix_sources(none).count() == 0
    given = spark.createDataFrame([("a", 50.0), (None, 1e9)], "source string, target double")
    got = {r.source: r._mix.target for r in mixing.mix_sources(sized, targets=given).collect()}
    assert got["a"] == 50 and got["b"] == 0 and got[None] == 2 * sizes[None]


@pytest.mark.parametrize("tilt", [0.5, 0.0])
def test_pareto_order(spark, docs, tilt):
    """Inclusion odds, whole copies and the order of the sample, document by document."""
    sized = docs.select("doc_id", "source", n_space_words("text").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    mixed = mixing.mix_sources(sized, tilt=tilt, budget=0.7, key=F.col("key")).collect()
    by = defaultdict(list)
    for r in mixed:
        by[r.source].append(r)
    some = 0
    for own in by.values():
        target = own[0]._mix.target
        expected = lambda c, n: 0.0 if n <= 0 else min(2.0, c * n**-tilt)
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(expected(mid, r.size) * r.size for r in own) < target else (low, mid)
        rest, drawn, want = target, [], {}
        for k, r in enumerate(own):
            e = expected(high, r.size)
            whole = int(e + 1e-9)
            want[k] = whole
            rest -= whole * r.size
            if e - whole > 1e-7:
                h = spark_hash(r.doc_id, r.key, (20,))
                u = ((h >> 12) + 0.5) / 2**52
                drawn.append((u / (1 - u) / ((e - whole) / (1 - e + whole)), k, r.size))
        so_far = 0
        for _, k, n in sorted(drawn):
            if so_far + n / 2 <= rest + 1e-6:
                want[k] += 1
                some += 1
            so_far += n
        assert Counter((r.doc_id, r.key, r._mix.copies) for r in own) == Counter((own[k].doc_id, own[k].key, n) for k, n in want.items())
    assert some > 10


def test_inclusion_follows_its_odds(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, 10).otherwise(40).cast("long").alias("size"))
    got = mixing.mix_sources(df, budget=0.5, weights=(1.0,)).groupBy("size").agg(F.avg("_mix.copies").alias("p"), F.sum("_mix.taken").alias("taken")).collect()
    p = {r["size"]: r.p for r in got}
    # odds fall with the square root of the size, and the words meet the target
    assert p[10] / p[40] == pytest.approx(2, rel=0.12) and abs(sum(r.taken for r in got) - 37500) <= 20


# -- 2 ---------------------------------------------------------------------------------------------


def test_licenses(spark, docs, none):
    text = "Note. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    more = [(500, text + " UNDER THE MIT\tLICENSE, cc-by-nc CC BY NC", 1), (501, text.replace("free of charge", "for money"), 1), (502, "cc byK nc the general public license version 3", 1), (503, "licensed under the GNU General Public License, version 3.", 1)]
    mine = docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame(more, "doc_id long, text string, size int"))
    rows = licenses.scan(mine).collect()
    assert len(rows) == mine.count()
    for r in rows:
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x]
        want = sorted((t.label, i) for t in licenses.BASE for p in [t.text.split()] for i in range(len(w)) if w[i : i + len(p)] == p)
        assert r._license.n_words == len(w)
        assert sorted((p.label, p.word) for p in r._license.places if p.base) == want
        assert r._license.base_labels == sorted({x for x, _ in want}) and set(r._license.base_labels) <= set(r._license.labels)
        assert 0 <= r._license.score <= 1 and (r._license.score > 0) == bool(r._license.labels)
    by = {r.doc_id: r._license.labels for r in rows}
    assert by[500] == ["cc-by-nc", "mit"] and by[501] == [] and by[502] == [] and by[503] == ["gpl-3"]
    assert licenses.scan(none).count() == 0
    # a filter on the result works out the same
    assert {r.doc_id for r in licenses.scan(mine).where("size(_license.labels) > 0").collect()} == {r.doc_id for r in rows if r._license.labels}


# -- 3 ---------------------------------------------------------------------------------------------


def repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeat_rows(seed):
    r = random.Random(seed)
    rows = [(x[0], x[1]) for x in nasty(seed)]
    passage = sentence(r, 25)
    rows += [(1000 + k, sentence(r, 8) + passage[k % 7 : len(passage) - k % 5] + sentence(r, 8)) for k in range(30)]
    rows += [(2000, "ab" * 400), (1999, "ba" * 90), (2001, "é" * 77), (2002, "é" * 30 + "\0" * 120), (2003, "\0" * 60), (1998, "\0" * 55)]
    r.shuffle(rows)
    return rows


DIGEST = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize(("seed", "heavy"), [(1, False), (2, False), (3, True)])
def test_repeats(spark, seed, heavy, monkeypatch):
    if heavy:  # every shard is dealt again by whole windows
        monkeypatch.setattr(suffixes, "HEAVY", 0)
        monkeypatch.setattr(suffixes, "HEAVY_WINDOWS", 0)
    if seed == 2:  # many parts, buckets of several tasks, levels of several batches
        monkeypatch.setattr(suffixes, "PART", 2000)
        monkeypatch.setattr(suffixes, "BATCH_WINDOWS", 500)
        monkeypatch.setattr(suffixes, "BLOCK", 64)
    rows = repeat_rows(seed)
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert tuples(found, *DIGEST) == repeats(rows)
    by = {(d, t or "") for d, t in rows}
    for r in found.collect():
        assert any(d == r.doc_id and len(t.encode()) == r.n_bytes for d, t in by) and r.runs == sorted(r.runs)


def test_repeats_empty(none):
    assert suffixes.remove_repeats(none).count() == 0


def test_repeats_of_a_very_long_text(spark):
    r = random.Random(8)
    long = sentence(r, 400_000)
    rows = [(5, long), (7, "new words first " + long[1_000_000:1_500_000] + " and last"), (3, "x" * 3_000_000)]
    got = {x.doc_id: x for x in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[7].n_removed >= len(long[1_000_000:1_500_000].encode()) and got[5].n_removed == got[3].n_removed == 0
    assert got[3].n_bytes == 3_000_000


def test_repeat_index_outlasts_a_call(spark, tmp_path):
    rows = repeat_rows(4)
    first = {}
    path = str(tmp_path / "index")
    sizes = []
    for k in range(5):
        batch = rows[k::5]
        index = suffixes.RepeatIndex(spark, path, shard_bits=3)  # found again by its manifest
        got = tuples(index.add(spark.createDataFrame(batch, "doc_id long, text string").repartition(3)), *DIGEST)
        want = Counter()
        for d, t in batch:
            b = (t or "").encode()
            for i in range(len(b) - 49 if d is not None else 0):
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
        for d, t in batch:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - 49 if d is not None else 0):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            want[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
        assert got == want, k
        sizes.append([n.bit_length() for _, n in index.levels])
        assert sizes[-1] == sorted(set(sizes[-1]), reverse=True)
    assert sum(n for _, n in index.levels) >= len(first) and any(len(x) < k for k, x in enumerate(sizes))


def test_family_levels(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 16)
    r = np.random.RandomState(0)
    family, seen = suffixes.Family(), {}
    for batch in range(12):
        store = r.randint(97, 99, 300).astype(np.uint8)
        store[r.randint(0, 300, 3)] = 120
        store = np.concatenate((store[:120], store[40:180], store))
        pos = np.arange(len(store) - 49)
        doc = batch * 40 + pos // 20
        got = family.scan(store, pos, doc)
        for p, d in zip(pos.tolist(), doc.tolist(), strict=True):
            seen.setdefault(store[p : p + 50].tobytes(), d)
        assert got.tolist() == [seen[store[p : p + 50].tobytes()] for p in pos.tolist()]
    sizes = [len(x).bit_length() for x in family.levels]
    assert sizes == sorted(set(sizes), reverse=True)
    for x in family.levels:
        keys = [x.key(k) for k in range(len(x))]
        assert keys == sorted(set(keys)) and [seen[k] for k in keys] == x.owner.tolist()


def test_packing():
    r = np.random.RandomState(3)
    for x in (np.zeros(0, np.int64), np.array([-5]), r.randint(-100, 100, 9), np.array([1 << 62, -(1 << 63), (1 << 63) - 1, 0]), r.randint(0, 1 << 40, 50)):
        assert suffixes._sums(suffixes._steps(x), len(x)).tolist() == x.tolist()
        assert suffixes._wide(suffixes._narrow(x), len(x)).tolist() == x.tolist()
    h = r.randint(0, 1 << 62, 7).astype(np.uint64)
    assert suffixes._from_six(suffixes._six(h)).tolist() == (h & np.uint64((1 << 48) - 1)).tolist()


def test_anchors_cut_anywhere(monkeypatch):
    t = [bytes(np.random.RandomState(1).randint(97, 101, 5000).astype(np.uint8)), b"short", b"a" * 50]
    def windows():
        return {(k, i, h) for own, hs, first, size in suffixes.anchors(t) for k, h, f, n in zip(own.tolist(), hs.tolist(), first.tolist(), size.tolist(), strict=True) for i in range(f, f + n)}
    whole = windows()
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    assert windows() == whole and len(whole) == 5000 - 49 + 1


# -- 4 ---------------------------------------------------------------------------------------------


def test_rules(spark, docs, none):
    r = random.Random(5)
    twice = sentence(r, 12)
    extra = [(900, f"{twice}.\n{twice}.\n\n\nwith end of the line here and there.\n{twice}."), (901, "Home | About | Contact | Help\nSign in to continue\n" + "A real sentence stands here and it is long enough to count as one of the words. " * 3), (902, "word%%% " * 40), (903, "Good line of text that ends well and goes on for a while, as good lines do, with words of all sorts in it.")]
    mine = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    for x in quality_rules.clean_lines(mine).collect():
        t, w, q = x.text or "", split_words(x.text), x._rules
        lines = [s for s in t.split("\n") if split_words(s)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
        assert (q.n_words, q.word_chars, q.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (q.n_dup_lines, q.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert q.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (q.base_failed and q.kept)
        assert len("".join(split_words(q.clean_text))) == q.word_chars - q.lost_chars
    by = {x.doc_id: x._rules for x in quality_rules.clean_lines(mine).collect()}
    assert "Home" not in by[901].clean_text and "Sign in" not in by[901].clean_text and by[901].lost_chars > 0
    assert not by[902].kept and by[902].lost_chars == by[902].word_chars and by[903].kept
    assert quality_rules.clean_lines(none).count() == 0
    assert quality_rules.clean_lines(docs).where("_rules.kept").columns == [*docs.columns, "_rules"]


# -- 5 ---------------------------------------------------------------------------------------------


def brute_print(t, k):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = split_words(w)
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(fps):
    label = list(range(len(fps)))
    change = True
    while change:
        change = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and bin(fps[i] ^ fps[j]).count("1") <= 3:
                    label[i], change = label[j], True
    return label


def test_simhash(spark, docs, none):
    rows = simhash.near_duplicates(docs, shingle=3).collect()
    assert len(rows) == docs.count()
    text = {(r.doc_id, r.text_key): r for r in rows}
    fps = [r.fps[0] % (1 << 64) for r in rows]
    label = closure(fps)
    for r, k in zip(rows, label, strict=True):
        ids = [x.doc_id for x, j in zip(rows, label, strict=True) if j == k and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    want = Counter((d, brute_print(t, 3)) for d, t, *_ in nasty())
    assert Counter((r.doc_id, f) for r, f in zip(rows, fps, strict=True)) == want and text
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(label)) and simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_keys_lose_nothing(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(pairs, "a long, b long")
    k = df.select(F.arrays_overlap(simhash._keys(F.col("a"), F.lit(0)), simhash._keys(F.col("b"), F.lit(0))).alias("k"))
    assert all(x.k for x in k.collect())
    finer = lambda c: F.flatten(F.transform(simhash._keys(F.col(c), F.lit(0)), lambda key: simhash._finer(F.col(c), key)))
    k = df.select(F.arrays_overlap(finer("a"), finer("b")).alias("k"), F.size(F.array_distinct(finer("a"))).alias("n"))
    assert all(x.k and x.n == 4 * simhash.KEYS for x in k.collect())


def test_simhash_crowded_keys(spark, docs, monkeypatch):
    want = sorted(simhash.near_duplicates(docs, prints=2).select("doc_id", "text_key", "component_id").collect(), key=str)
    monkeypatch.setattr(simhash, "CROWDED", 2)
    monkeypatch.setattr(simhash, "_SAMPLED", 1)
    assert want == sorted(simhash.near_duplicates(docs, prints=2).select("doc_id", "text_key", "component_id").collect(), key=str)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_simhash_forest(monkeypatch, limit):
    # one key's group: bits outside the start's segment and a few in the others
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", limit)
    r = random.Random(2)
    fps = np.unique(np.array([sum(1 << b for b in r.sample(range(16, 64), r.randint(0, 4))) for _ in range(60)], np.uint64))
    label = simhash._forest(fps, 0)
    ok = lambda x: all(bin(x & sum(0xFFFF << 16 * j for j in range(1, n))).count("1") <= n * 3 // 4 for n in range(1, 5))
    want = list(range(len(fps)))
    for _ in range(len(fps)):
        want = [min([want[i]] + [want[j] for j in range(len(fps)) if ok(int(fps[i] ^ fps[j]))]) for i in range(len(fps))]
    assert label.tolist() == want


# -- 6 ---------------------------------------------------------------------------------------------


def norm(t):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]


def test_leaks(spark, docs, none):
    r = random.Random(9)
    own = [" ".join(f"w{r.randrange(400)}" for _ in range(n)) for n in (30, 45, 12, 6, 5, 5, 3, 1)]
    items = [(k, t) for k, t in enumerate([*own, own[0].upper() + "!", "", None])]
    def change(t, n):
        w = t.split()
        for i in r.sample(range(len(w)), n):
            w[i] = "changed"
        return " ".join(w)
    extra = [(700 + k, sentence(r, 300) + " " + t + ". " + sentence(r, 50)) for k, t in enumerate([own[0], change(own[0], 1), change(own[1], 1), change(own[1], 4), own[2], own[3], own[6], own[7], own[1] + " " + own[2]])]
    mine = docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(*x, 1) for x in extra], "doc_id long, text string, size int"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    classes = defaultdict(list)
    for i, t in items:
        if w := norm(t):
            classes[min(5, len(w)), frozenset(grams(w, min(5, len(w))))].append(i)
    want = set()
    for x in mine.select("doc_id", "text").collect():
        for (k, g), ids in classes.items():
            n = len(g & grams(norm(x.text), k))
            if n >= 0.8 * len(g):
                want.add((x.doc_id, min(ids), tuple(sorted(ids)), len(g), n))
    got = [(r.doc_id, r.item_id, tuple(r.same_items), r.n_shingles, r.n_found) for r in decontaminate.find_leaks(mine, bench).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) >= 9
    left = decontaminate.without_leaks(mine, bench)
    assert left.columns == mine.columns and {r.doc_id for r in left.collect()}.isdisjoint({d for d, *_ in want})
    assert left.count() == sum(1 for x in mine.collect() if x.doc_id not in {d for d, *_ in want})
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(mine, bench.limit(0)).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------


def test_sharding(spark, docs, none):
    rows = sharding.shard_rows(docs, n_shards=8).collect()
    n = docs.count()
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in rows) == Counter((x[0], x[3], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in nasty())
    counts = Counter(r.shard for r in rows)
    assert sum(counts.values()) == n and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for src, total in Counter(r.source for r in rows).items():
        share = Counter(r.shard for r in rows if r.source == src)
        assert all(abs(share[s] - total / 8) < 2 for s in range(8))
    again = sharding.shard_rows(docs.repartition(2), n_shards=8).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert sharding.shard_rows(none).count() == 0
    few = sharding.shard_rows(docs.where("doc_id < 3").limit(3), n_shards=8).collect()
    assert all(r.slot == 0 for r in few) and len({r.shard for r in few}) == 3


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints and longs (an int is a 1-tuple); nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("spread", [False, True])
def test_fractional_order(spark, docs, spread):
    """The order of the places by brute force, rank by rank."""
    rows, count = [], Counter()
    for x in nasty():
        t, src = x[1] or "", x[3]
        h = signed(spark_hash(t, (7,)))
        copy = count[x[0], h] if spread else 0
        count[x[0], h] += 1
        each = signed(spark_hash(x[0], h, copy, (7,)))
        key = each if spread else signed(spark_hash(h, (7,)))
        rows.append((src, key, each, x[0], len(t.encode()) + 1, zlib.crc32(t.encode())))
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    null = lambda v: (v is not None, v or 0)
    placed = []
    for src, own in by.items():
        # ranges are of the hash's bits without a sign; inside a range, signed
        own.sort(key=lambda r: ((r[1] % (1 << 64)) >> 60, r[1], r[2], null(r[3])))
        placed += [((k + 0.5) / len(own), (src is not None, (src or "").encode()), r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: (x[0], x[1], x[2][1], x[2][2], null(x[2][3])))
    n = len(placed)
    want = [(r[3], r[0], r[4], r[5], k * 8 // n) for k, (_, _, r) in enumerate(placed)]
    got = sharding.shard_rows(docs, spread=spread).collect()
    got.sort(key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.source, r.size, r.text_crc32, r.shard) for r in got] == want


def test_equal_texts_and_copies(spark, monkeypatch):
    r = random.Random(4)
    texts = [sentence(r, 30) + str(k) for k in range(300)]
    rows = [(k, texts[k % 300], "en", r.choice("ab")) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    shard = defaultdict(set)
    for x in sharding.shard_rows(df).collect():
        shard[x.text_crc32].add(x.shard)
    assert sum(len(v) > 1 for v in shard.values()) < 110  # by chance 295 of 300 would be split
    # ranges with more than HOT rows are cut again: the same counts, and still gapless
    monkeypatch.setattr(sharding, "HOT", 3)
    hot = sharding.shard_rows(df).collect()
    assert sorted(Counter(x.shard for x in hot).values()) == [112] * 4 + [113] * 4
    assert sorted((x.shard, x.slot) for x in hot) == [(k, j) for k in range(8) for j in range(Counter(x.shard for x in hot)[k])]
    # repeated rows, dealt like any other
    again = spark.createDataFrame([x for x in rows[:300] for _ in range(2)], df.schema).repartition(3)
    order = sorted(sharding.shard_rows(again, spread=True).collect(), key=lambda x: (x.shard, x.slot))
    for src in "ab":
        own = [x.doc_id for x in order if x.source == src]
        assert sum(a == b for a, b in zip(own, own[1:], strict=False)) < 12
    reordered = sharding.shard_rows(again.repartition(5), spread=True).collect()
    assert Counter(map(tuple, order)) == Counter(map(tuple, reordered))


def test_write_shards(spark, docs, none, tmp_path):
    mine = docs.withColumn("shard", F.lit("theirs")).withColumn("slot", F.col("doc_id"))
    placed = sharding.shard_docs(mine, n_shards=3, spread=True)
    assert placed.columns == [*mine.columns, "_place"]
    sharding.write_shards(placed, str(tmp_path / "s"), files=7)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r[c] for c in [*docs.columns, "shard_", "slot_"]) for r in back.collect()) == Counter(map(tuple, mine.collect()))
    for k in range(3):
        files = sorted((tmp_path / "s" / f"shard={k}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert len(files) > 1 and slots == list(range(len(slots)))
    want = Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(mine, n_shards=3, spread=True).collect())
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == want
    assert sharding.shard_docs(none).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b\\\\[\\INST]", "<|im_end|><|im_sep|>", "<<s>", "", None, "😀<|im_start|>\n", "x" * 5000, "\\"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(odd + ["end"])]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "user", "u"), (4, 1, "user", "v"), (4, 2, "assistant", "a"), (5, 0, "user", "only"), (6, 0, "we\nird<|im_sep|>", "t"), (7, 0, None, "t"), (None, 0, "user", "n"), (None, None, "assistant", "m"), (8, 1, "user", "same"), (8, 1, "user", "same")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    made = chat.join_turns(chat.format_turns(df)).withColumn("t", chat.formatted("segments"))
    got = {r.conv_id: r for r in made.select("conv_id", "valid", "t", chat.loss_text("segments").alias("loss"), chat.read_back(F.col("t")).alias("back")).collect()}
    by = defaultdict(list)
    for c, n, role, t in rows:
        by[c].append((n is not None, n or 0, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(b.role, b.text) for b in got[c].back] == [(x[2], x[3]) for x in turns]
        assert got[c].loss == "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c].t.count("<|im_start|>") == len(turns) and "[INST]" not in got[c].t and "</s>" not in got[c].t
    assert {c for c in got if got[c].valid} == {1, 2}
    assert chat.join_turns(chat.format_turns(df.limit(0))).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ b\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (9, "http://b", ""), (5, "u", "x" * 200_000), (None, "n", "<p>é</p>"), (7, "d", "same"), (7, "d", "same"), (8, "e", "same"), (10, "f", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, html string, refers_to string")
    warc.write_pages(df, str(tmp_path / "w"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) for r in warc.read_pages(spark, str(tmp_path / "w")).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        again = i is not None and i > f
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None, True] += 1
    assert got == want
    warc.write_pages(df, str(tmp_path / "l"), min_revisit_bytes=5)
    assert {r.page_id for r in warc.read_pages(spark, str(tmp_path / "l")).where("record_type = 'revisit'").collect()} == {3}
    # also other readers see one stream of records
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert len(list(warc.records(io.BytesIO(data)))) >= len(rows) + 1


def test_warc_framing():
    good = warc.page_record(1, "u", b"payload" * 9000, None)
    (h, block, ok), = warc.records(io.BytesIO(good))
    assert ok and h["warc-type"] == "response" and block.endswith(b"payload")
    plain = zlib.decompress(good, 31)
    pack = lambda b: (lambda z: z.compress(b) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    assert [ok for _, _, ok in warc.records(io.BytesIO(pack(plain.replace(b"payloadp", b"Payloadp", 1))))] == [False]
    for bad in (plain[:-5], plain + b"x", plain.replace(b"WARC/", b"CRAW/")):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(pack(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(good[:-30])))
    assert list(warc.records(io.BytesIO(warc.EMPTY_MEMBER * 2))) == []


# -- 10 --------------------------------------------------------------------------------------------


def test_quality_model(spark, docs, none):
    d = "/root/testdata/sf0.01"
    own, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = lambda k: labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k)
    got = quality_model.score(own, half(0)).select("doc_id", "kept").join(half(1), "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    made = quality_model.score(docs, labels)
    assert made.count() == docs.count()
    for r in made.collect():
        assert 0 < r.quality < 1 and 0 < r.path_quality < 1
    # without labels nothing is rejected
    assert quality_model.score(docs, labels.limit(0)).where("not kept").count() == 0
    assert quality_model.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality_model.score(none, labels).count() == 0 and quality_model.keep_good(none, labels).columns == none.columns


def test_sites_shrink(spark):
    # one document of a small site, beside large sites: its site's rate stays near the global one
    own = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "zz%%% " * 9).otherwise("Plain words stand here in a row.").alias("text"), F.when(F.col("id") < 299, "big").otherwise("tiny").alias("source"), F.lit("en").alias("lang"))
    labels = own.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    r = {x.doc_id: x for x in quality_model.score(own, labels).collect()}
    assert abs(r[299].path_quality - 2 / 3) < 0.05 and r[1].kept and not r[0].kept


def test_posteriors_by_force(spark):
    """Sums, strengths and leave-one-out posteriors in plain Python, from the model's evidence."""
    r0 = random.Random(12)
    sites = [(r0.choice(["a", "a", "a", "b", "c", None]), r0.choice(["x", "y", "z", None])) for _ in range(250)]
    good = lambda h, p: r0.random() < {"a": 0.9, "b": 0.5, "c": 0.15, None: 0.7}[h] - 0.35 * (p == "z")
    rows = [(k, ("Plain words stand here in a row and so on. " if good(h, p) else "zz%%% ## ") * r0.randint(1, 9), h, p) for k, (h, p) in enumerate(sites)]
    rows += [rows[4], rows[4], (None, "x", "lonely", "x"), (7, "another text of this id", "b", "x"), (900, None, "d", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int("%" not in rows[k][1])) for k in range(0, 250, 3)] + [(0, None), (999, 1)], "doc_id long, quality int")
    label = {k: float("%" not in rows[k][1]) for k in range(0, 250, 3)}
    got = quality_model.score(df, labels).withColumnRenamed("text_key", "t").collect()
    keys = {(d, signed(spark_hash(t or ""))): (h, p) for d, t, h, p in rows}
    of = [keys[r.doc_id, r.t] for r in got]
    e = [label.get(r.doc_id, r.doc_quality) for r in got]
    n, s, hn, hs = Counter(), Counter(), Counter(), Counter()
    for (h, p), x in zip(of, e, strict=True):
        n[h, p] += 1
        s[h, p] += x
        hn[h] += 1
        hs[h] += x
    m, inside = sum(e) / len(e), lambda x: min(max(x, 1e-6), 1 - 1e-6)

    def strength(groups):  # (size, sum, prior mean)
        g = len(groups)
        # a group's mean varies by c (1 - c) / a around its prior if sites do not differ
        between = sum(a * ((b / a - c) ** 2 - c * (1 - c) / a) for a, b, c in groups) / sum(a for a, _, _ in groups)
        return min(max(sum(c * (1 - c) for _, _, c in groups) / g / max(between, 1e-9) - 1, 1.0), 1e4)

    k1 = strength([(hn[h], hs[h], m) for h in hn])
    prior = {h: inside((k1 * m + hs[h]) / (k1 + hn[h])) for h in hn}
    k2 = strength([(n[x], s[x], prior[x[0]]) for x in n])
    assert 1 < k1 < 1e4 and 1 < k2 < 1e4
    logit = lambda x: np.log(inside(x) / (1 - inside(x)))
    for r, (h, p), x in zip(got, of, e, strict=True):
        rate = inside((sum(e) - x) / (len(e) - 1))
        host = inside((k1 * rate + hs[h] - x) / (k1 + hn[h] - 1))
        path = inside((k2 * host + s[h, p] - x) / (k2 + n[h, p] - 1))
        q = 1 / (1 + np.exp(-(logit(r.doc_quality) + logit(path) - logit(rate))))
        assert (r.host_quality, r.path_quality, r.quality) == pytest.approx((host, path, q), abs=2e-6)
        assert r.kept == (r.quality >= 0.5)
    again = quality_model.score(df.repartition(7), labels).collect()
    assert Counter(map(tuple, quality_model.score(df, labels).collect())) == Counter(map(tuple, again))


def test_fit_on_one_class():
    w = quality_model.fit(np.ones((3, 2)), np.ones(3))
    assert w[0] > 0 and not w[1:].any()


# -- columns of any name ---------------------------------------------------------------------------

NAMES = "_mix _license _rules _place _copy _i _k _key _row _t _n _s _h _of _number _task _words _lines _w _at _range _rank _mi _ids _many shard slot size n h key node host path f y deal bucket kind tag first copies taken segments label places".split()


@pytest.mark.parametrize("some", [NAMES, [x.upper() for x in NAMES]])
def test_columns_of_any_name(spark, some):
    base = spark.createDataFrame([x[:4] for x in nasty(6, 30)], "doc_id long, text string, lang string, source string")
    mine = base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(some)])
    values = tuple(range(len(some)))

    def whole(df, extra=0):
        """Rows of documents with all of the user's values."""
        assert df.columns[: len(mine.columns)] == mine.columns and len(df.columns) == len(mine.columns) + extra
        rows = [tuple(r)[: len(mine.columns)] for r in df.collect()]
        assert all(r[4:] == values for r in rows)
        return Counter(r[:4] for r in rows)

    every = Counter(map(tuple, base.collect()))
    labels = base.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"))
    bench = spark.createDataFrame([(1, "the of and wood river"), (2, None)], "item_id long, text string")
    mixed = mixing.mix_sources(mine, size=n_space_words("text"), key=F.xxhash64("text"))
    assert whole(mixed, 1) == every
    copies = Counter(r[0] for r in mixed.select(f"{mixed.columns[-1]}.copies").collect())
    assert sum(whole(mixing.expand(mixed)).values()) == copies[1] + 2 * copies[2]
    assert whole(licenses.scan(mine), 1) == every and whole(quality_rules.clean_lines(mine), 1) == every
    assert whole(sharding.shard_docs(mine, spread=True), 1) == every
    left = whole(quality_model.keep_good(mine, labels))
    assert left == whole(quality_model.keep_good(base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(some)]), labels)) and left
    plain = Counter(map(tuple, simhash.keep_one(base, shingle=5, threshold=0.8).collect()))
    assert whole(simhash.keep_one(mine, shingle=5, threshold=0.8)) == plain and sum(plain.values()) < sum(every.values())
    assert whole(decontaminate.without_leaks(mine, bench)) == Counter(map(tuple, decontaminate.without_leaks(base, bench).collect()))
    assert suffixes.remove_repeats(mine).count() == simhash.near_duplicates(mine).count() == sum(every.values())
    assert sharding.shard_rows(mine).count() == quality_model.score(mine, labels).count() == sum(every.values())
