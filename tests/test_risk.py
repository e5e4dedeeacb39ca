from __future__ import annotations

import datetime as dt
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelvar.operators import garch, overlay, risk
from panelvar.settings import DateWindow, OverlaySettings


TRUE = garch.GJR(omega=0.03, alpha=0.04, gamma=0.12, beta=0.86)


def simulate(n: int, seed: int = 0) -> np.ndarray:
    """Returns whose variances chain through the growth factor of each day's residual."""
    z = np.random.default_rng(seed).standard_normal(n)
    growth = TRUE.beta + (TRUE.alpha + TRUE.gamma * (z < 0)) * z**2
    h = np.fromiter(accumulate(growth[:-1], lambda v, g: TRUE.omega + g * v, initial=1.0), float)
    return np.sqrt(h) * z


def series(spark, r, asset="A", start="2008-01-01"):
    return spark.createDataFrame(
        pd.DataFrame({"asset": asset, "trade_date": pd.bdate_range(start, periods=len(r)).date, "r": r})
    )


def test_fit_recovers_parameters():
    h0, omega, alpha, gamma, beta, nll = garch.maximise(simulate(8000))
    assert abs(alpha - TRUE.alpha) < 0.03 and abs(gamma - TRUE.gamma) < 0.05 and abs(beta - TRUE.beta) < 0.05
    at_truth = garch.neg_loglik(simulate(8000), h0, *([np.array([x]) for x in (TRUE.omega, TRUE.alpha, TRUE.gamma, TRUE.beta)]))
    assert alpha + gamma / 2 + beta < 1 and nll <= float(at_truth[0])


def test_variance_path_and_forecast(spark):
    r = simulate(200)
    rows = series(spark, r / 100).selectExpr("asset", "trade_date", "r * 100 AS x").withColumns(
        {**TRUE.columns(), "h0": F.lit(1.5)}
    )
    got = garch.variance_path(rows).withColumn("f", garch.average_forecast(5)).orderBy("trade_date").toPandas()
    h = [1.5]
    for x in r[:-1]:
        h.append(TRUE.omega + (TRUE.alpha + TRUE.gamma * (x < 0)) * x * x + TRUE.beta * h[-1])
    assert np.allclose(got.h, h, rtol=1e-10)
    v = TRUE.omega + (TRUE.alpha + TRUE.gamma * (r[-1] < 0)) * r[-1] ** 2 + TRUE.beta * h[-1]
    total = 0.0
    for _ in range(5):
        total += v
        v = TRUE.omega + (TRUE.alpha + TRUE.gamma / 2 + TRUE.beta) * v
    assert got.f.iloc[-1] == pytest.approx(total / 5)


def test_historical_is_causal_and_exact(spark):
    x = np.random.default_rng(1).normal(0, 0.01, 620)
    got = risk.historical(series(spark, x), [0.95, 0.99]).orderBy("trade_date").toPandas()
    one = got[got.conf == 0.99].reset_index(drop=True)
    for i in (0, 57, 119):
        w = x[i : i + 500]
        q = np.quantile(w, 0.01)
        assert one["var"][i] == pytest.approx(-q, rel=1e-9) and one["es"][i] == pytest.approx(-w[w <= q].mean(), rel=1e-9)
    shocked = x.copy()
    shocked[560:] *= 10
    again = risk.historical(series(spark, shocked), [0.99]).orderBy("trade_date").toPandas()
    assert np.allclose(again["var"][:61], one["var"][:61])


def test_normal_exception_rate_and_backtest_table(spark):
    x = np.random.default_rng(2).normal(0, 0.01, 4000)
    returns = series(spark, x)
    exc = risk.exceptions(returns, risk.normal_ewma(returns, [0.95, 0.99]))
    table = {r.conf: r for r in risk.backtest_table(exc).collect()}
    assert 0.04 < table[0.95].rate < 0.075 and 0.8 < table[0.95].es_ratio < 1.2
    assert table[0.99].basel_green + table[0.99].basel_yellow + table[0.99].basel_red == pytest.approx(1.0)
    assert table[0.95].basel_green is None and 0 <= table[0.95].kupiec_p <= 1


def binomial_log(x, n, p):
    return (x * np.log(p) if x else 0.0) + ((n - x) * np.log1p(-p) if n > x else 0.0)


@pytest.mark.parametrize("hits,days,p", [(13, 260, 0.05), (7, 520, 0.01), (0, 120, 0.01), (40, 400, 0.05), (9, 9, 0.5)])
def test_coverage_is_twice_the_gain_in_log_likelihood(spark, hits, days, p):
    got = spark.range(1).select(risk.kupiec_lr(F.lit(hits), F.lit(days), F.lit(p))).first()[0]
    assert got == pytest.approx(2 * (binomial_log(hits, days, hits / days) - binomial_log(hits, days, p)), abs=1e-9)


@pytest.mark.parametrize("counts", [(400, 20, 18, 2), (300, 6, 6, 30), (50, 0, 0, 0)])
def test_independence_is_twice_the_gain_of_two_rates_over_one(spark, counts):
    n00, n01, n10, n11 = counts
    got = spark.range(1).select(risk.christoffersen_lr(*map(F.lit, counts))).first()[0]
    two = sum(binomial_log(x, n, x / n) for x, n in ((n01, n00 + n01), (n11, n10 + n11)) if n)
    one = binomial_log(n01 + n11, sum(counts), (n01 + n11) / sum(counts))
    assert got == pytest.approx(2 * (two - one), abs=1e-9)


def test_basel_zones(spark):
    hits = [1] * 10 + [0] * 590
    days = pd.bdate_range("2010-01-01", periods=600).date
    exc = spark.createDataFrame(pd.DataFrame({"asset": "A", "method": "m", "conf": 0.99, "trade_date": days, "exc": hits}))
    row = risk.basel_shares(exc).first()
    assert row.basel_red == pytest.approx(1 / 351) and row.basel_yellow == pytest.approx(5 / 351)


def test_filtered_simulation_and_monte_carlo(spark):
    r = simulate(1600, 3) / 100
    returns = series(spark, r)
    fits = risk.yearly_fits(returns, 500)
    got = risk.filtered_historical(returns, fits, [0.95, 0.99]).toPandas()
    assert dt.date(2010, 1, 1) <= got.trade_date.min() < dt.date(2010, 1, 5) and (got["es"] >= got["var"]).all() and (got["var"] > 0).all()
    shocked = r.copy()
    shocked[-50:] *= 5
    late = sorted(got.trade_date.unique())[-50]
    again = risk.filtered_historical(series(spark, shocked), risk.yearly_fits(series(spark, shocked), 500), [0.95, 0.99]).toPandas()
    key = ["trade_date", "conf"]
    a, b = (f[f.trade_date < late].sort_values(key)["var"].to_numpy() for f in (got, again))
    assert np.allclose(a, b)
    params = spark.createDataFrame([("A", 1.0)], "asset string, h0 double").withColumns(TRUE.columns())
    state = risk.simulation_state(returns, params)
    one = {x.conf: x for x in risk.monte_carlo(state, [0.95, 0.99], 10, 20_000, seed=1).collect()}
    two = {x.conf: x for x in risk.monte_carlo(state, [0.95, 0.99], 10, 20_000, seed=1, chunks=5).collect()}
    assert one[0.99]["var"] > one[0.95]["var"] > 0 and one[0.99]["es"] > one[0.99]["var"]
    assert one[0.99]["var"] == two[0.99]["var"]


def test_portfolio_and_stress(spark):
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2016-03-01", periods=900).date
    loads = {"core": 1.0, "small": 1.4, "gold": -0.3}
    factor = rng.standard_t(6, 900) / 120
    assets = {a: b * factor + (rng.normal(0, 0.003, 900) if a != "core" else 0) for a, b in loads.items()}
    returns = spark.createDataFrame(pd.DataFrame([(a, d, x) for a, xs in assets.items() for d, x in zip(days, xs)], columns=["asset", "trade_date", "r"]))
    fit = {a: np.polyfit(assets["core"], xs, 1)[0] for a, xs in assets.items()}
    got = {r.asset: r.beta for r in risk.betas(returns, list(assets), "core").collect()}
    assert got == pytest.approx(fit)
    w = {"core": 0.7, "gold": 0.3}
    sd = {a: np.std(assets[a], ddof=1) for a in w}
    rho = np.corrcoef(assets["core"], assets["gold"])[0, 1]
    # Deviations times 1.5, correlation a quarter of the way to 1.
    x, y = (1.5 * w[a] * sd[a] for a in w)
    want = np.sqrt(x * x + y * y + 2 * x * y * (rho + 0.25 * (1 - rho)))
    assert risk.stressed_normal(returns, w, 0.99, 1.5, 0.25).first().sigma == pytest.approx(want)
    shocks = {"all": {"core": -0.3, "gold": 0.1}, "one": {"gold": -0.2}}
    loss = {r.scenario: r.loss for r in risk.joint_shock(risk.weights_frame(spark, w), shocks).collect()}
    assert loss == pytest.approx({"all": -0.18, "one": -0.06})
    short = returns.where(F.col("trade_date") != F.lit(days[3])).unionByName(returns.where((F.col("trade_date") == F.lit(days[3])) & (F.col("asset") == "core")))
    assert risk.portfolio_returns(short, w).count() == 899


def test_drawdown_counts_the_first_loss(spark):
    rows = spark.createDataFrame([("A", i, x) for i, x in enumerate([-0.5, 0.1, 0.2])], "asset string, trade_date int, r double")
    assert risk.with_drawdown(rows, ["asset"]).agg(risk.max_drawdown()).first()[0] == pytest.approx(-0.5)


def overlay_inputs(spark, n=12):
    days = pd.bdate_range("2020-01-01", periods=n).date
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(
        {"asset": "A", "trade_date": days, "r": rng.normal(0, 0.01, n), "ewma_vol": 0.2, "vix": 25.0, "cash": 0.0001, "p_m": rng.random(n)}
    )
    return frame, spark.createDataFrame(frame)


def test_weights_lag_cost_and_static_match(spark):
    frame, df = overlay_inputs(spark)
    w = overlay.build_weights(df, ["m"], 0.10)
    first = w.orderBy("trade_date").first()
    assert (first.w_buy_hold, first.w_ewma_vol_target, first.w_vix_target) == (1.0, 0.5, pytest.approx(0.4))
    bt = overlay.run_backtest(w, ["m"], 2, 5.0, frame.trade_date[0], frame.trade_date[11], "model_m").toPandas()
    one = bt[bt.strategy == "model_m"].sort_values("trade_date").reset_index(drop=True)
    held = (1 - frame.p_m)[:-2].to_numpy()
    assert np.allclose(one.held, held) and one.turnover[0] == pytest.approx(held[0])
    net = held * frame.r[2:] + (1 - held) * 0.0001 - np.abs(np.diff(held, prepend=0)) * 5 / 1e4
    assert np.allclose(one.net, net)
    assert np.allclose(bt[bt.strategy == "static_matched"].held, held.mean())
    perf = {r.strategy: r for r in overlay.performance(spark.createDataFrame(bt)).collect()}
    assert perf["model_m"].avg_exposure == pytest.approx(perf["static_matched"].avg_exposure)
    table = overlay.episode_table(spark.createDataFrame(bt), [DateWindow("e", frame.trade_date[2], frame.trade_date[5])]).collect()
    got = [r.e_total_return for r in table if r.strategy == "model_m"][0]
    assert got == pytest.approx(np.prod(1 + net[:4]) - 1)


def test_sensitivity_repeats_the_base_case(spark):
    frame, df = overlay_inputs(spark, 60)
    ends = frame.trade_date[0], frame.trade_date[59]
    grid = overlay.sensitivity(df, ["m"], *ends, "model_m")
    row = grid.where("lag = 2 AND cost_bps = 5 AND target_vol = 0.1 AND strategy = 'model_m'").first()
    base = overlay.performance(overlay.run_backtest(overlay.build_weights(df, ["m"], 0.10), ["m"], 2, 5.0, *ends, "model_m"))
    assert row.sharpe == pytest.approx(base.where("strategy = 'model_m'").first().sharpe)
    assert grid.count() == 2 * 4 * 3 * 5


def test_sensitivity_keeps_every_lag(spark):
    frame, df = overlay_inputs(spark, 30)
    grid = overlay.sensitivity(df, ["m"], frame.trade_date[0], frame.trade_date[29], "model_m", OverlaySettings(lags=(1, 3, 5), costs_bps=(5.0,), target_vols=(0.1,)))
    assert sorted({r.lag for r in grid.collect()}) == [1, 3, 5] and grid.count() == 3 * 5


def test_open_price_of_large_keys_and_prices(spark, tmp_path):
    from panelvar.sources import panel

    day = dt.datetime(2020, 1, 2)
    lines = [(1 << 40, 1, day, 200_000.0, 0.0, 1.0), ((1 << 40) + 1, 1, day, 1.0, 0.0, 1.0), (1 << 62, 2, day, 5_000_000_000.25, 0.0, 1.0), (1 << 62, 2, day, 7e9, 0.0, 1.0)]
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_extendedprice double, l_discount double, l_quantity double")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.asset: r.open for r in panel.prices(spark, str(tmp_path)).collect()} == {"A1": 200_000.0, "A2": 5_000_000_000.25}
