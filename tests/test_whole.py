"""Queries do their whole job: every fold, round, tree and asset."""

from __future__ import annotations

import inspect

import pandas as pd

from panelvar.operators import models
from panelvar.plans import registry
from panelvar.sources import panel

from .conftest import price_frame


def test_tuned_forest_runs_every_fold_at_full_length(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(registry, "_fitted", lambda p, specs, folds: seen.append((specs, list(folds))))
    registry.QUERIES["rf_tuned"](spark, "unused")
    ((specs, folds),) = seen
    assert folds == list(panel.WALK_FORWARD) and [s.name for s in specs] == ["random_forest"]
    assert all(specs[0].make(config, 1000).getNumTrees() == 300 for config in specs[0].configurations)


def test_tuned_boosting_runs_every_fold_at_full_length(spark, monkeypatch):
    length = inspect.signature(models.boosted_walk_forward).parameters["iterations"].default
    seen = []
    monkeypatch.setattr(registry, "_fit_rows", lambda p: None)
    monkeypatch.setattr(
        registry.models, "boosted_walk_forward", lambda rows, folds, features, **more: seen.append((list(folds), features, more)) or (None, None)
    )
    registry.QUERIES["gbt_tuned"](spark, "unused")
    assert seen == [(list(panel.WALK_FORWARD), registry.MODEL_FEATURES, {})] and length == 150


def test_covariance_covers_every_asset(spark, monkeypatch):
    names = [f"A{i}" for i in range(1, 8)]
    frame = pd.concat([price_frame(a, 60, seed=i) for i, a in enumerate(names)], ignore_index=True)
    monkeypatch.setattr(registry, "pin", lambda df: df)
    monkeypatch.setattr(panel, "prices", lambda spark_, d: spark.createDataFrame(frame))
    monkeypatch.setattr(panel, "assets", lambda spark_, d: spark.createDataFrame([(a,) for a in names], "asset string"))
    got = {(r.asset_i, r.asset_j): r["cov"] for r in registry.QUERIES["cov_matrix_all"](spark, "unused").collect()}
    want = frame.pivot(index="trade_date", columns="asset", values="adj_close").pct_change().dropna().cov()
    assert set(got) == {(a, b) for a in names for b in names}
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-7 for a, b in got)
