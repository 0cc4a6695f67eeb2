"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from hopscale.llm import jaccard

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def kept_by_force(rows):
    """Sorted (doc_id, text) of the rows that one row of each component leaves; ids are distinct."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            root[find(i)] = find(j)
    low = {}
    for i, (k, t) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), (k, t)), (k, t))
    return sorted(low.values())


def near_copies(seed=1):
    """Texts with a copy whose similarity is a little above or below 0.8, by one contiguous change or by scattered words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = []
    for k in range(60):
        w = [word() for _ in range(104)]
        new = list(w)
        if k % 2:  # m changed words in a row change m + 4 of 100 shingles
            m = 5 + k % 5
            new[40 : 40 + m] = [word() for _ in range(m)]
        else:  # each changed word changes 5 of 100 shingles
            for at in range(10, 10 + 20 * (1 + k % 3), 20):
                new[at] = word()
        texts += [" ".join(w), " ".join(new)]
    chain = [word() for _ in range(104)]
    for k in range(5):  # a chain whose neighbours are near, its ends not
        texts.append(" ".join(chain))
        chain[20 * k : 20 * k + 6] = [word() for _ in range(6)]
    return texts + ["", None, " \n", "one two", "One two", "one two three"]


def stage(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], SCHEMA)
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, D).collect())


def test_finds_all_near_copies(spark):
    rows = list(enumerate(near_copies()))
    key = lambda x: (x[0], x[1] or "")
    assert set(map(key, stage(spark, rows))) <= set(map(key, kept_by_force(rows)))


def test_keeps_all_others(spark):
    rows = list(enumerate(near_copies(2)))
    key = lambda x: (x[0], x[1] or "")
    assert set(map(key, stage(spark, rows))) >= set(map(key, kept_by_force(rows)))


def test_stage_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    assert len({k for k, _ in rows}) == len(rows)
    assert stage(spark, rows) == kept_by_force(rows)


def test_crowded_bands_lose_nothing(spark, monkeypatch):
    # a chain of near copies, texts near one text but partly not near each other, and strangers
    monkeypatch.setattr(jaccard, "CROWDED", 500)
    made, put = {}, jaccard.Scratch.put
    monkeypatch.setattr(jaccard.Scratch, "put", lambda self, df, name: made.setdefault(name, put(self, df, name)))
    rows = list(enumerate(crowd()))
    assert [x[0] for x in stage(spark, rows)] == [x[0] for x in kept_by_force(rows)]
    # some bands hold texts that are not in their largest component
    assert made["crowded"].count() > 10 and made["outside"].count() > 10 and made["all_edges"].count() > 0


def crowd(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = near_copies(4)
    w = [word() for _ in range(104)]
    for _ in range(40):
        w[r.randrange(100)] = word()
        texts.append(" ".join(w))
    w = [word() for _ in range(104)]
    for _ in range(60):
        new = list(w)
        for at in r.sample(range(5, 99), r.randrange(2, 7)):
            new[at] = word()
        texts += [" ".join(new)]
        new[50] = word()
        texts += [" ".join(new)]
    return texts


def test_bands_agree_as_often_as_they_should():
    r = np.random.default_rng(1)
    same = []
    for _ in range(300):
        h = r.integers(0, 1 << 64, 250, np.uint64)
        same.append(jaccard.bands(np.sort(h[:225])) == jaccard.bands(np.sort(np.concatenate((h[:200], h[225:])))))
    assert np.mean(same) == pytest.approx(0.8**5, abs=0.015) and np.any(same, axis=1).all()


def test_forest_links_what_all_pairs_link():
    r = np.random.default_rng(2)
    for _ in range(30):
        base = r.integers(0, 1 << 40, 60)
        sets = [np.unique(np.where(r.random(60) < r.choice([0.02, 0.1, 0.3]), r.integers(0, 1 << 40, 60), base)) for _ in range(25)]
        u, v = jaccard.forest(np.concatenate(sets), np.array(list(map(len, sets))), 0.8)
        assert len(u) < 25
        linked = lambda edges: {frozenset(c) for c in groups(edges, 25)}
        assert linked(zip(u, v, strict=True)) == linked((i, j) for i, j in combinations(range(25), 2) if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8)


def groups(edges, n):
    of = {i: {i} for i in range(n)}
    for i, j in edges:
        if of[i] is not of[j]:
            of[i] |= of[j]
            for x in of[j]:
                of[x] = of[i]
    return of.values()
