from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelvar.operators import inference, metrics, models, splits
from panelvar.settings import Fold, InferenceSettings, yearly_folds


def scored(spark, frame):
    return spark.createDataFrame(frame)


def average_precision(y, p):
    order = sorted(set(p), reverse=True)
    area, seen = 0.0, 0
    for t in order:
        chosen = [v for v, q in zip(y, p) if q >= t]
        hits = sum(chosen)
        area += (hits - seen) * hits / len(chosen)
        seen = hits
    return area / sum(y)


def test_metrics_against_definitions(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    frame = pd.DataFrame({"model": "m", "fold": np.where(np.arange(400) < 150, "f1", "f2"), "prob": p, "y": y})
    got = {r.scope: r for r in metrics.evaluate(scored(spark, frame)).collect()}
    assert set(got) == {"f1", "f2", "pooled"}
    for scope, part in [("f1", frame[:150]), ("f2", frame[150:]), ("pooled", frame)]:
        q, v = part.prob.to_numpy(), part.y.to_numpy()
        wins = (q[v == 1][:, None] > q[v == 0]).mean() + 0.5 * (q[v == 1][:, None] == q[v == 0]).mean()
        assert got[scope].roc_auc == pytest.approx(wins, abs=1e-12)
        assert got[scope].pr_auc == pytest.approx(average_precision(list(v), list(q)), abs=1e-12)
        assert got[scope].brier == pytest.approx(((q - v) ** 2).mean())
        c = np.clip(q, 1e-6, 1 - 1e-6)
        assert got[scope].log_loss == pytest.approx(-(v * np.log(c) + (1 - v) * np.log(1 - c)).mean())
        bins = pd.qcut(part.prob, 10, duplicates="drop")
        g = part.groupby(bins, observed=True)
        ece = (g.size() * (g.prob.mean() - g.y.mean()).abs()).sum() / len(part)
        assert got[scope].ece == pytest.approx(ece, abs=1e-12)


def test_single_class_and_constant_score(spark):
    frame = pd.DataFrame({"model": "m", "fold": "f", "prob": [0.3] * 5, "y": [0] * 5})
    row = [r for r in metrics.evaluate(scored(spark, frame)).collect() if r.scope == "f"][0]
    assert row.roc_auc is None and row.pr_auc is None and row.ece == pytest.approx(0.3)
    assert {r.metric for r in metrics.metrics_long(metrics.evaluate(scored(spark, frame))).collect()} == {
        "brier", "log_loss", "ece", "prevalence",
    }


def modeling_rows(days: int = 1500, seed: int = 0) -> pd.DataFrame:
    """Clustered volatility: the label follows a persistent factor that the features observe."""
    rng = np.random.default_rng(seed)
    v = np.zeros(days + 5)
    for i in range(1, days + 5):
        v[i] = 0.97 * v[i - 1] + rng.normal(0, 0.2)
    dates = pd.bdate_range("2005-01-03", periods=days + 5).date
    return pd.DataFrame(
        {
            "asset": "A",
            "as_of_date": dates[:days],
            "label_known_date": dates[5:],
            "rv_5d": np.exp(v[:days]) / 10,
            "vix_level": np.exp(v[:days] + rng.normal(0, 0.3, days)) * 15,
            "y": (v[5:] > 0.5).astype(int),
        }
    )


def test_purging_holdout_and_folds(spark):
    rows = spark.createDataFrame(modeling_rows())
    kept = splits.eligible_rows(rows, ["rv_5d"], dt.date(2006, 1, 2), dt.date(2010, 1, 1))
    span = kept.selectExpr("min(as_of_date) AS a", "max(as_of_date) AS b").first()
    assert span.a == dt.date(2006, 1, 2) and span.b < dt.date(2010, 1, 1)
    got = splits.assign_folds(kept, yearly_folds(2008, 2009)).toPandas()
    for fold, start in (("wf_2008", dt.date(2008, 1, 1)), ("wf_2009", dt.date(2009, 1, 1))):
        train = got[(got.fold == fold) & (got.role == "train")]
        test = got[(got.fold == fold) & (got.role == "test")]
        assert (train.label_known_date < start).all() and (test.as_of_date.map(lambda d: d.year) == start.year).all()
        # The five rows before the test block are purged.
        assert (pd.Timestamp(start) - pd.Timestamp(train.as_of_date.max())).days > 6
    inner = splits.inner_splits(spark.createDataFrame(got[got.role == "train"]), min_rows=200).toPandas()
    assert (inner.n_train >= 200).all() and inner[inner.fold == "wf_2009"].year.max() == 2008


def test_parameter_grid_order(spark):
    got = splits.parameter_grid(spark, {"a": (1, 2), "b": (3, 4, 5)}).orderBy("grid_pos").collect()
    assert [(r.grid_pos, r.a, r.b) for r in got][:4] == [(0, 1.0, 3.0), (1, 1.0, 4.0), (2, 1.0, 5.0), (3, 2.0, 3.0)]


def test_logit_matches_newton_and_ignores_test_labels(spark):
    frame = modeling_rows()
    fold = [Fold("wf_2009", dt.date(2009, 1, 1), dt.date(2009, 12, 31))]
    spec = models.Spec("persistence_logit", "persistence", ("rv_5d",), models.logit)
    got, _ = models.walk_forward(spark.createDataFrame(frame), [spec], fold, threads=2)
    got = got.toPandas().sort_values("as_of_date")
    train = frame[frame.label_known_date < dt.date(2009, 1, 1)]
    test = frame[frame.as_of_date.map(lambda d: d.year) == 2009]
    x = np.log(train.rv_5d.to_numpy())
    mean, sd = x.mean(), x.std()
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (p - train.y) + np.r_[0, w[1]]
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1.0]), grad)
    want = 1 / (1 + np.exp(-(w[0] + w[1] * (np.log(test.rv_5d) - mean) / sd)))
    assert np.allclose(got.prob, want, atol=1e-5)
    auc = (got.prob[got.y == 1].to_numpy()[:, None] > got.prob[got.y == 0].to_numpy()).mean()
    assert auc > 0.65
    flipped = frame.copy()
    flipped.loc[flipped.as_of_date >= dt.date(2009, 1, 1), "y"] = 1 - flipped.y
    again = models.walk_forward(spark.createDataFrame(flipped), [spec], fold, threads=2)[0].toPandas()
    assert np.allclose(again.sort_values("as_of_date").prob, got.prob)


def test_tuning_logs_every_configuration(spark):
    rows = spark.createDataFrame(modeling_rows())
    spec = models.Spec("logit_tuned", "logistic", ("rv_5d", "vix_level"), models.logit, {"C": (0.01, 1.0)})
    fold = [Fold("wf_2010", dt.date(2010, 1, 1), dt.date(2010, 12, 31))]
    preds, trials = models.walk_forward(rows, [spec], fold)
    assert sorted(r.params for r in trials.collect()) == ["{'C': 0.01}", "{'C': 1.0}"]
    best = metrics.best_configuration(trials).first()
    assert best.score == min(r.score for r in trials.collect())
    assert preds.where("prob < 0 OR prob > 1").count() == 0


def test_resampling_blocks():
    index = inference.resample(np.arange(200), 500, 12345, 20)
    assert index.min() >= 0 and index.max() < 500
    joined = (index[:, 1:] - index[:, :-1]) % 500 == 1
    assert 17 < 1 / (1 - joined.mean()) < 23
    counts = inference.resample_counts(np.arange(200), 500, 12345, 20)
    assert (counts.sum(axis=1) == 500).all() and abs(counts.mean(axis=0).std()) < 0.35
    assert (inference.resample(np.arange(5), 500, 12345, 20) == index[:5]).all()


def test_weighted_average_precision_equals_repeated_rows():
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 40), np.round(rng.random(40), 1)
    counts = rng.integers(0, 4, (3, 40))
    got = inference.average_precision(counts, y, p)
    for row, ap in zip(counts, got):
        assert ap == pytest.approx(average_precision(list(np.repeat(y, row)), list(np.repeat(p, row))))


def test_holm_and_equal_models(spark):
    df = spark.createDataFrame([("A", "f", "m", str(i), p) for i, p in enumerate((0.01, 0.04, 0.03))], "asset string, family string, model string, vs string, p double")
    got = {r.vs: r.h for r in inference.holm(df, ["asset", "family"], "p", "h").collect()}
    assert got == {"0": pytest.approx(0.03), "2": pytest.approx(0.06), "1": pytest.approx(0.06)}
    same = spark.createDataFrame([("A", "k", i, 0.0) for i in range(30)], "asset string, g string, t int, d double")
    row = inference.dm_test(same, ["asset", "g"], ["t"]).first()
    assert row.stat is None and row.p_dm == 1.0


def test_loss_test_against_formula(spark):
    d = np.random.default_rng(8).normal(0.1, 1, 120)
    df = spark.createDataFrame(pd.DataFrame({"asset": "A", "t": np.arange(120), "d": d}))
    row = inference.dm_test(df, ["asset"], ["t"], 5).first()
    c = d - d.mean()
    v = c @ c / 120 + 2 * sum((1 - k / 5) * (c[k:] @ c[:-k]) / 120 for k in range(1, 5))
    stat = d.mean() / np.sqrt(v / 120) * np.sqrt((120 + 1 - 10 + 20 / 120) / 120)
    assert row.stat == pytest.approx(stat) and 0 < row.p_dm < 1


def test_pairwise_and_sharpe_tests(spark):
    rng = np.random.default_rng(6)
    rows = []
    for fold, start in (("f1", "2020-01-01"), ("f2", "2021-01-01")):
        days = pd.bdate_range(start, periods=120).date
        truth = rng.random(120)
        y = (rng.random(120) < truth).astype(int)
        for model, p in (("good", truth), ("bad", rng.random(120)), ("copy", truth)):
            rows.append(pd.DataFrame({"model": model, "fold": fold, "asset": "A", "as_of_date": days, "prob": p, "y": y}))
    preds = spark.createDataFrame(pd.concat(rows))
    pairs = [("x", "good", "bad"), ("x", "good", "copy")]
    got = {r.vs: r for r in inference.pairwise_tests(preds, pairs, InferenceSettings(draws=200)).collect()}
    assert got["bad"].pr_auc_diff > 0.1 and got["bad"].p_boot < 0.05 and got["bad"].p_dm < 0.05
    assert got["bad"].ci_low < got["bad"].pr_auc_diff < got["bad"].ci_high
    assert got["copy"].pr_auc_diff == 0 and got["copy"].p_boot == 1.0 and got["copy"].p_dm == 1.0
    days = pd.bdate_range("2020-01-01", periods=400).date
    x = rng.normal(0.001, 0.01, 400)
    excess = pd.concat([pd.DataFrame({"asset": "A", "trade_date": days, "strategy": s, "x": v}) for s, v in (("a", x), ("b", x - 0.002), ("c", x))])
    got = {r.vs: r for r in inference.sharpe_tests(spark.createDataFrame(excess), [("x", "a", "b"), ("x", "a", "c")], InferenceSettings(draws=200)).collect()}
    assert got["b"].sharpe_diff == pytest.approx((0.002 / x.std(ddof=1)) * 252**0.5) and got["b"].p_boot < 0.05
    assert got["c"].sharpe_diff == pytest.approx(0, abs=1e-12) and got["c"].p_boot == 1.0
