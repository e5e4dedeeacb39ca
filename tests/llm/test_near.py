from __future__ import annotations

import random
from collections import Counter

import numpy as np

from panelvar.llm import near


def members(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(id, text) -> (id, set size, component, kept) by comparing all pairs."""
    sets = [members(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = low.get(find(k)) if sets[k] else i
        out[i, len(sets[k]), c, i == c] += 1
    return out


def test_equals_all_pairs(docs, docs_rows):
    got = Counter((r["doc"]["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect())
    assert got == brute([(r[0], r[1]) for r in docs_rows])


def test_clusters_that_only_far_members_link(spark, monkeypatch):
    """Several texts around each of a few bases, some linked by one pair alone; both ways of reading candidates."""
    rng = random.Random(8)
    rows = []
    for c in range(6):
        base = [f"v{rng.randint(0, 900)}" for _ in range(120)]
        for k in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
            rows.append((c * 100 + k, " ".join(words)))
    rng.shuffle(rows)
    want = brute(rows)
    monkeypatch.setattr(near, "BROADCAST_ROWS", -1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["doc"]["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect())
    assert got == want


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.75, 0.9):
        err = []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            same = int(round(2000 * share / (1 + share) / 2))
            a, b = np.concatenate([x[:same], x[same : 500 + 0]]) if same < 500 else x[:same], None
            b = np.concatenate([x[:same], x[500 : 500 + len(a) - same]]) if len(a) > same else x[:same]
            true = same / (len(a) + len(b) - same)
            err.append(near.estimate(near.sketch(a)[None], near.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.05


def test_sketches_merge():
    x = np.random.default_rng(4).integers(0, 1 << 63, 700).astype(np.uint64)
    assert (near.sketch(x) == np.maximum(near.sketch(x[:400]), near.sketch(x[300:]))).all()


def test_no_documents(no_docs):
    assert near.near_duplicates(no_docs).collect() == []
