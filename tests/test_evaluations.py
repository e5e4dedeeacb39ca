"""Stored walk-forward results: replaced by key, joined to outcomes, refused on other data."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelvar.operators import evaluations

SCORES = "model string, fold string, grid_pos int, params string, score double"


def inputs(spark, models, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=60).date
    preds = pd.DataFrame(
        [(m, f"f{k % 2}", "A", d, float(rng.uniform()), int(rng.integers(2))) for m in models for k, d in enumerate(days)],
        columns=["model", "fold", "asset", "as_of_date", "prob", "y"],
    )
    info = pd.DataFrame(
        {
            "fold": ["f0", "f1"],
            "train_start": [dt.date(2010, 1, 4), dt.date(2011, 1, 3)],
            "train_end": [dt.date(2018, 12, 31), dt.date(2019, 12, 31)],
        }
    )
    trials = [(m, f, i, f"c={i}", abs(i - 1) + 0.1) for m in models[:1] for f in ("f0", "f1") for i in range(3)]
    return preds, spark.createDataFrame(preds), spark.createDataFrame(info), spark.createDataFrame(trials, SCORES)


def stored(spark, root, name, *columns):
    return sorted(tuple(r) for r in evaluations.read(spark, root, name).select(*columns).collect())


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Two models, published twice; then one of them again with other numbers; then another purpose."""
    root = str(tmp_path_factory.mktemp("store"))
    _, preds, info, trials = inputs(spark, ["a", "b"])
    for _ in range(2):
        evaluations.publish(root, preds, info, trials, "walk_forward", "lab", "h1")
    _, preds, info, trials = inputs(spark, ["b"], seed=9)
    evaluations.publish(root, preds, info, trials, "walk_forward", "lab", "h2")
    evaluations.publish(root, preds, info, trials.limit(0), "holdout", "lab", "h2")
    return root


def test_one_set_of_rows_per_key(spark, root):
    frames = {"a": inputs(spark, ["a", "b"])[0], "b": inputs(spark, ["b"], seed=9)[0]}
    want = [
        (purpose, m, r.fold, r.as_of_date, r.prob)
        for purpose, m in (("walk_forward", "a"), ("walk_forward", "b"), ("holdout", "b"))
        for r in frames[m].itertuples()
        if r.model == m
    ]
    assert stored(spark, root, "prediction", "purpose", "model", "fold", "as_of_date", "prob") == sorted(want)


def test_versions_with_spans_and_chosen_settings(spark, root):
    got = stored(spark, root, "version", "purpose", "model", "fold", "train_start", "chosen", "n_predictions", "data_hash")
    early, late = dt.date(2010, 1, 4), dt.date(2011, 1, 3)
    assert got == [
        (p, m, f, late if f == "f1" else early, None if f == "pooled" or p == "holdout" else "c=1", 60 if f == "pooled" else 30, h)
        for p, m, h in (("holdout", "b", "h2"), ("walk_forward", "a", "h1"), ("walk_forward", "b", "h2"))
        for f in ("f0", "f1", "pooled")
    ]
    ids = [v for (v,) in stored(spark, root, "version", "version")]
    assert len(set(ids)) == len(ids) == 9
    for name in ("prediction", "metric", "trial"):  # no row without its version
        assert {v for (v,) in stored(spark, root, name, "version")} <= set(ids)


def test_metrics_per_fold_and_pooled(spark, root):
    frame = inputs(spark, ["b"], seed=9)[0]
    got = {(f, k): v for f, k, v in stored(spark, root, "metric", "fold", "metric", "value") if k == "brier"}
    rows = {f: v for p, m, f, k, v in stored(spark, root, "metric", "purpose", "model", "fold", "metric", "value") if (p, m, k) == ("holdout", "b", "brier")}
    square = (frame.prob - frame.y) ** 2
    want = {"pooled": square.mean(), **square.groupby(frame.fold).mean().to_dict()}
    assert got and rows.keys() == want.keys() and all(abs(rows[f] - want[f]) < 1e-12 for f in want)


def test_outcomes_come_from_the_labels(spark, root):
    frame = inputs(spark, ["b"], seed=9)[0]
    labels = frame.assign(y=[None if k % 3 == 0 else int(k % 2) for k in range(len(frame))])[["asset", "as_of_date", "y"]]
    labels = spark.createDataFrame([(a, d, None if pd.isna(y) else int(y)) for a, d, y in labels.itertuples(index=False)], "asset string, as_of_date date, y int")
    got = evaluations.outcomes(spark, root, labels, "holdout", "lab")
    assert got.count() == 40 and {r.model for r in got.collect()} == {"b"}
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(purpose" in plan


def test_other_data_are_refused(spark, root):
    evaluations.frozen_hash(spark, root, "holdout", "lab", "h2")
    with pytest.raises(ValueError, match="3 of 6 stored versions"):
        evaluations.frozen_hash(spark, root, "walk_forward", "lab", "h2")
    with pytest.raises(ValueError, match="nothing is stored"):
        evaluations.frozen_hash(spark, root, "walk_forward", "other", "h2")
    with pytest.raises(ValueError, match="no table"):
        evaluations.read(spark, root, "fit")
