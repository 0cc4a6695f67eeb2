"""The pipeline's candidates come from SimHash fingerprints and pigeonring chains, and none within the distance is lost."""

import random

import numpy as np
import pytest
from test_jaccard import kept_by_force, near_copies, stage

from hopscale.llm import jaccard, rings, simhash
from hopscale.scratch import Scratch


def close(fps):
    """Smallest index that links of at most 7 differing bits reach."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 7
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label, len(fps)).min(1)
        if (new == label).all():
            return label
        label = new


def some_prints(seed, n=12, copies=15):
    r = np.random.default_rng(seed)
    out = []
    for b in r.integers(0, 1 << 64, n, np.uint64).tolist():
        for _ in range(copies):
            out.append(b ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 9), replace=False)))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("limit", [0, 3, 512])
def test_chains_lose_nothing(monkeypatch, limit):
    monkeypatch.setattr(rings, "PAIRS_UP_TO", limit)
    for seed in range(3):
        fps = some_prints(seed)
        assert (rings.forest(fps, range(8)) == close(fps)).all()
        label = np.arange(len(fps))
        for start in range(8):
            label = rings._joined(label, np.arange(len(fps)), rings.forest(fps, [start]))
        assert (label == close(fps)).all()


def test_prints_are_majorities():
    own = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 700, np.uint64))
    first = (own ^ (own >> np.uint64(31))) * rings._ODD[0]
    first = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    first ^= first >> np.uint64(32)
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in first.tolist()) > len(own))
    assert int(rings.prints(own)[0]) % (1 << 64) == want
    assert not rings.prints(own[:0]).any() and len(rings.prints(own)) == rings.PRINTS


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_candidates_connect_all_near_prints(spark, monkeypatch, held):
    monkeypatch.setattr(rings, "HELD", held)
    monkeypatch.setattr(rings, "PRINTS", 2)
    monkeypatch.setattr(rings, "ROUND", 1)
    fps = np.stack([some_prints(5)[:150], np.random.default_rng(6).permutation(some_prints(7)[:150])], 1)
    nodes = spark.createDataFrame([(k, f.view(np.int64).tolist()) for k, f in enumerate(fps)], "node long, fps array<long>")
    found = rings.candidates(Scratch(spark), nodes).collect()
    for which in range(2):
        label = np.arange(len(fps))
        deals = [r for r in found if r.deal >> 11 == which]
        assert (len({r.deal for r in deals}) > 8) == (held == 40)
        label = rings._joined(label, np.array([r.node for r in deals]), np.array([r.root for r in deals]))
        assert (label == close(fps[:, which])).all()


def test_stage_compares_what_fingerprints_find(spark, monkeypatch):
    # with fingerprints that say nothing there are no links, with true ones all at 0.8 or more; four and five shingles are exact
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = near_copies(5)
    for _ in range(40):
        w = [word() for _ in range(9)]
        texts += [" ".join(w), " ".join(w[:-1])]
    rows = list(enumerate(texts))
    assert [x[0] for x in stage(spark, rows)] == [x[0] for x in kept_by_force(rows)]
    monkeypatch.setattr(jaccard, "prints", lambda own: np.full(64, own.sum().astype(np.int64)))
    docs = spark.createDataFrame(rows[:120], "doc_id long, text string")
    assert simhash.keep_one(docs, shingle=5, threshold=0.8).count() == 120 > len(kept_by_force(rows[:120]))
