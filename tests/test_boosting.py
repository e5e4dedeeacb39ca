"""Boosting over blocks equals a plain numpy version; short windows give no rows instead of an error."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelvar.operators import boosting, models
from panelvar.operators.boosting import Fit
from panelvar.settings import Fold

FEATURES = ["a", "b", "c"]


def frame(n: int = 700, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + np.where(x[:, 1] > 0, 1.0, -1.0) * x[:, 2] + rng.normal(size=n) > 0).astype(int)
    days = [date(2010, 1, 1) + timedelta(days=3 * k) for k in range(n)]
    rows = pd.DataFrame(x, columns=FEATURES).assign(asset="X", as_of_date=days, y=y)
    return rows.assign(label_known_date=[d + timedelta(days=7) for d in days])


def plain(rows: pd.DataFrame, edges, cutoff, depth, rate, rounds, min_leaf, penalty) -> np.ndarray:
    bins = np.stack([np.searchsorted(e, rows[f].to_numpy()) for f, e in zip(FEATURES, edges)])
    train = (rows["label_known_date"] < cutoff).to_numpy()
    y = rows["y"].to_numpy()
    score = np.full(len(rows), np.log(y[train].mean() / (1 - y[train].mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(rows))

        def grow(every, level):
            own = every & train
            step[every] = -rate * g[own].sum() / (h[own].sum() + penalty)
            best = (1e-12, None)
            for f in range(len(FEATURES)) if level < depth else ():
                for cut in range(boosting.BINS - 1):
                    left, right = own & (bins[f] <= cut), own & (bins[f] > cut)
                    if left.sum() < min_leaf or right.sum() < min_leaf:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, right)) - g[own].sum() ** 2 / (h[own].sum() + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
            if best[1]:
                f, cut = best[1]
                grow(every & (bins[f] <= cut), level + 1)
                grow(every & (bins[f] > cut), level + 1)

        grow(np.ones(len(rows), bool), 0)
        score += step
    return 1 / (1 + np.exp(-score))


def test_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 150)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    rows = frame()
    df = spark.createDataFrame(rows)
    fits = [Fit(date(2013, 1, 1), 2, 0.1), Fit(date(2015, 1, 1), 3, 0.3)]
    got = boosting.boost(df, FEATURES, fits, iterations=5, min_leaf=30).toPandas()
    edges = boosting.bin_edges(df, FEATURES)
    assert len(got) == 2 * len(rows)
    for k, fit in enumerate(fits):
        mine = got[got["fit"] == k].sort_values("as_of_date")["prob"].to_numpy()
        assert np.allclose(mine, plain(rows, edges, fit.cutoff, fit.depth, fit.rate, 5, 30, 1.0), atol=1e-9)


def test_penalty_shrinks_leaves(spark):
    df = spark.createDataFrame(frame())
    spread = []
    for penalty in (0.0, 1000.0):
        got = boosting.boost(df, FEATURES, [Fit(date(2015, 1, 1), 2, 0.3)], iterations=2, penalty=penalty).toPandas()
        spread.append(got["prob"].std())
    assert spread[1] < spread[0] / 3


def test_tuned_predictions_and_trials(spark):
    df = spark.createDataFrame(frame(900))
    folds = [Fold("wf_2010", date(2010, 1, 1), date(2010, 12, 31)), Fold("wf_2016", date(2016, 1, 1), date(2016, 12, 31))]
    found, trials = models.boosted_walk_forward(df, folds, FEATURES, iterations=3, min_rows=200)
    out, log = found.toPandas(), trials.toPandas()
    assert set(out["fold"]) == {"wf_2016"} and out["prob"].between(0, 1).all()
    assert len(out) == sum(d.year == 2016 for d in frame(900)["as_of_date"])
    assert len(log) == 4 and (log["splits"] == 3).all() and log["score"].between(0.1, 2).all()
    assert models.boosted_walk_forward(df, folds[:1], FEATURES, iterations=3)[0].count() == 0


@pytest.mark.parametrize("depth", [1, 3])
def test_places_follow_the_cuts(depth):
    tree = boosting.Tree.empty(depth)
    tree.feature[0], tree.cut[0] = 1, 4
    assert tree.places(np.array([[9, 9, 0], [4, 5, 0]])).tolist() == [1, 2, 1]


def test_jobs_carry_recent_trees_and_every_core_has_a_block(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "LEAST_ROWS", 100, raising=False)
    sent, parts = [], []
    plain, packed = boosting._splits, boosting._blocks
    monkeypatch.setattr(boosting, "_splits", lambda blocks, fits, *more: sent.append(max(len(f.trees) for f in fits)) or plain(blocks, fits, *more))
    monkeypatch.setattr(boosting, "_blocks", lambda *all: parts.append(packed(*all)) or parts[-1])
    boosting.boost(spark.createDataFrame(frame()), FEATURES, [Fit(date(2015, 1, 1), 1, 0.3)], iterations=6, min_leaf=30)
    assert max(sent) == 1  # those since the last refresh
    assert parts[0].count() >= spark.sparkContext.defaultParallelism
