"""The likelihood search ends at an optimum, or says that it has not."""

from __future__ import annotations

import numpy as np
import pytest

from panelvar.operators import garch

from .test_risk import simulate


def inside(lv, a, g, lq):
    """Parameters from (log long-run variance, alpha, gamma, log(1 - persistence)), and their validity."""
    gap = np.exp(lq)
    omega, beta = np.exp(lv) * gap, 1 - gap - a - g / 2
    ok = (a >= 0) & (a <= garch.MAX_ALPHA) & (g >= 0) & (g <= garch.MAX_GAMMA) & (beta >= 0) & (beta <= garch.MAX_BETA)
    return omega, beta, ok & (gap >= 1 - garch.MAX_PERSISTENCE) & (omega >= garch.MIN_OMEGA)


def slopes(r, h0, omega, alpha, gamma, beta):
    """Gains in likelihood that small steps along (long-run variance, alpha, gamma, persistence) would still bring."""
    gap = 1 - alpha - gamma / 2 - beta
    at = np.array([np.log(omega / gap), alpha, gamma, np.log(gap)])
    steps = np.concatenate([np.eye(4), -np.eye(4)]) * np.array([0.05, 0.003, 0.005, 0.05])
    points = np.concatenate([[at], at + steps])
    w, b, ok = inside(*points.T)
    ok[0] = True
    score = garch.neg_loglik(r, h0, w[ok], points[ok, 1], points[ok, 2], b[ok])
    return score[0] - score[1:]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_no_neighbour_of_the_fit_is_better(seed):
    for r in (simulate(1500, seed), np.random.default_rng(seed).standard_normal(1200)):
        h0, omega, alpha, gamma, beta, nll, converged = garch.search(r)
        assert converged and slopes(r, h0, omega, alpha, gamma, beta).max() < 1e-6


def test_a_search_cut_short_is_marked():
    assert garch.search(simulate(300), most_rounds=3)[-1] is False


def test_score_equals_differences_of_the_likelihood():
    r = simulate(700, 4)
    target = garch.Likelihood(r)
    x = np.array([0.05, 0.04, 0.08, 0.9])
    ends = [garch.neg_loglik(r, target.h0, *(x + d)[:, None]) - garch.neg_loglik(r, target.h0, *(x - d)[:, None]) for d in np.eye(4) * 1e-6]
    assert np.allclose(target.score(x)[0], np.concatenate(ends) / 2e-6, rtol=1e-5)
    assert target.value(x) == pytest.approx(garch.neg_loglik(r, target.h0, *x[:, None])[0], rel=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_bounded_step_is_no_worse_than_any_feasible_one(seed):
    rng = np.random.default_rng(seed)
    half = rng.normal(size=(4, 4))
    curvature, gradient = half @ half.T + 0.1 * np.eye(4), rng.normal(size=4) * 3
    x = np.array([0.02, 0.05, 0.1, 0.85])
    room = garch._B - garch._A @ x
    d = garch.bounded_step(gradient, curvature, room)
    assert (garch._A @ d <= room + 1e-9).all()
    others = rng.normal(size=(20000, 4)) * 0.2
    others = others[(others @ garch._A.T <= room).all(axis=1)]
    cost = others @ gradient + np.einsum("ni,ij,nj->n", others, curvature, others) / 2
    assert gradient @ d + d @ curvature @ d / 2 <= cost.min() + 1e-12


def test_a_flat_series_has_no_fit():
    assert garch.search(np.zeros(100))[-1] is False


def test_unconverged_fits_fail_the_queries_that_use_them(spark):
    fits = spark.createDataFrame([(1.0, True), (2.0, False)], "h0 double, converged boolean")
    assert [r.h0 for r in garch.settled(fits.where("converged")).collect()] == [1.0]
    with pytest.raises(Exception, match="failed to converge"):
        garch.settled(fits).collect()
