from __future__ import annotations

import numpy as np
import pytest

from panelvar.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, row long, v int, place long"


def table(n=3000, d=16):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[50:400] = x[50]  # equal vectors
    rows = [(k, [float(c) for c in v], 0, 0, 0, 0) for k, v in enumerate(x)]
    rows += [rows[7], rows[300]]
    odd = [(9000, None), (9100, [0.0] * d), (9200, [float("nan")] + [1.0] * (d - 1)), (9300, [None] + [1.0] * (d - 1)), (9400, [float("inf")] * d), (9500, [1.0] * 3), (None, [1.0] * d)]
    return x, rows + [(i, v, 0, 0, 0, 0) for i, v in odd]


def exact(x, q, k):
    d = np.sqrt(np.square(x.astype(float) - x[q].astype(float)).sum(axis=1))
    d[q] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return order.tolist(), d[order].tolist()


def test_recall_scores_and_ties(spark):
    x, rows = table()
    out = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), lambda i: i % 100 == 0).collect()
    found: dict = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, answers in found.items():
        ids, _ = exact(x, q, 10)
        hits += len(set(ids) & {i for i, _ in answers})
        assert len(answers) == 10 and answers == sorted(answers, key=lambda a: (a[1], a[0]))
        for i, score in answers:
            assert score == pytest.approx(np.sqrt(np.square(x[i].astype(float) - x[q].astype(float)).sum()), rel=1e-12)
    assert hits >= 0.9 * 300
    assert [i for i, _ in found[200]] == list(range(50, 60)) and [i for i, _ in found[100]] == list(range(50, 60))


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, 0, 0, 0), (5, [0.0, 1.0], 0, 0, 0, 0), (6, [0.0, 1.0], 0, 0, 0, 0)]
    out = neighbours.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 100 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 5), (0, 2, 6)]
    assert neighbours.search(spark.createDataFrame([], SCHEMA), lambda i: i % 100 == 0).collect() == []


def test_curve_visits_neighbours():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    order = np.argsort(neighbours.hilbert(side, 3))
    assert sorted(neighbours.hilbert(side, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(side[order].astype(int), axis=0)).sum(axis=1) == 1).all()
