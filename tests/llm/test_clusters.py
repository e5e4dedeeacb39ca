from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from panelvar.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string"


def vectors(n=300, size=64, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (5, size))
    rows = [(k, [float(np.float32(v)) for v in middle[k % 5] + rng.normal(0, 0.3, size)]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (size - 1)), (n + 3, [None] + [1.0] * (size - 1)), (n + 4, [math.nan] * size)]
    rows += [(n + 5, [math.inf] + [0.0] * (size - 1)), (n + 6, [0.0] * size), (None, [0.5] * size), rows[7], rows[7]]
    return rows


def brute(rows, k, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def far(v, j):
        return sum((a - b) ** 2 for a, b in zip(v, c[j]))

    for turn in range(rounds + 1):
        best = [min(range(len(c)), key=lambda j: (far(v, j), j)) for _, v in kept]
        if turn < rounds:
            for j in set(best):
                own = [v for (_, v), b in zip(kept, best) if b == j]
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, b, far(v, b)) for (i, v), b in zip(kept, best)]
    sums = {j: sum(d for _, b, d in out if b == j) for j in set(best)}
    return [(i, b, d, sums[b], sum(sums.values()), ",".join(map(str, c[b]))) for i, b, d in out]


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in rows], SCHEMA).repartition(5)
    got = clusters.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()
    assert by_row(map(tuple, got)) == by_row(brute(rows, 16, 3))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(6)
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in rows], SCHEMA)
    got = clusters.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()
    assert by_row(map(tuple, got)) == by_row(brute(rows, 16, 3))
    assert clusters.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_huge_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([1e30, -3e25, 2.0**60, 0.3]) for _ in range(64)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["cluster"]) for r in clusters.cluster(df, k=4).collect()}
    assert got == {r[:2] for r in brute(rows, 4, 3)}


def test_ties_go_to_the_smaller_number():
    match = clusters.Tournament([[2, 0], [0, 0], [-2, 0], [0, 0]])
    assert match.winners(np.array([[1, 5], [-1, 0], [0, 0], [-9, 1]])).tolist() == [0, 1, 1, 2]
