from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelvar.operators import features as ft
from panelvar.operators import labels as lb
from panelvar.operators import pit
from panelvar.settings import PanelRoles, Target
from panelvar.sources import sinks

ROLES = PanelRoles("X1", "X7", "X5", ("X2", "X3", "X4"), ("X5", "X6"), "D1", "D2", "D3", "D4", "M1", "M2")


def macro_frames(days: int = 700) -> tuple[pd.DataFrame, pd.DataFrame]:
    rng = np.random.default_rng(9)
    dates = pd.bdate_range("2014-06-02", periods=days).date
    daily = pd.concat(
        [pd.DataFrame({"series": f"D{i}", "observation_date": dates, "value": rng.normal(size=days)}) for i in range(1, 5)]
    )
    rows = []
    for s in ("M1", "M2"):
        for m in pd.date_range("2013-01-01", periods=50, freq="MS").date:
            first, second = m + dt.timedelta(35), m + dt.timedelta(120)
            v = float(rng.normal(100, 5))
            rows.append((s, m, first, second - dt.timedelta(1), v))
            rows.append((s, m, second, dt.date(9999, 12, 31), v + float(rng.normal(0, 1))))
    return daily, pd.DataFrame(rows, columns=["series", "observation_date", "valid_from", "valid_to", "value"])


@pytest.fixture(scope="module")
def inputs(spark, panel_frame):
    daily, monthly = macro_frames()
    return spark.createDataFrame(panel_frame), pit.rule_lag(spark.createDataFrame(daily)), spark.createDataFrame(monthly)


def as_pandas(df, keys=("asset", "as_of_date")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def test_truncation_invariance(inputs):
    """Features at t are the same on data cut at t, for every feature and asset."""
    prices, daily, monthly = inputs
    cut = F.lit(dt.date(2016, 3, 15))
    full = as_pandas(ft.compute_features(prices, daily, monthly, ROLES))
    part = as_pandas(
        ft.compute_features(
            pit.truncate_prices(prices, cut), pit.truncate_vintages(daily, cut), pit.truncate_vintages(monthly, cut), ROLES
        )
    )
    kept = full[full.as_of_date <= dt.date(2016, 3, 15)].reset_index(drop=True)
    pd.testing.assert_frame_equal(kept, part, rtol=1e-9)
    last = part[part.as_of_date == part.as_of_date.max()]
    assert last.drop(columns=["asset", "as_of_date"]).notna().all().all()


def test_leaky_operator_fails_the_truncation_check(inputs):
    prices = inputs[0]
    leak = lambda df: as_pandas(df.selectExpr("asset", "trade_date AS as_of_date", "avg(close) OVER (PARTITION BY asset) AS m"))
    cut = dt.date(2016, 3, 15)
    full, part = leak(prices), leak(prices.where(F.col("trade_date") <= F.lit(cut)))
    with pytest.raises(AssertionError):
        pd.testing.assert_frame_equal(full[full.as_of_date <= cut].reset_index(drop=True), part, rtol=1e-9)


def test_price_features_against_pandas(inputs, panel_frame):
    got = as_pandas(ft.price_features(inputs[0]), ("asset", "trade_date"))
    one, g = panel_frame[panel_frame.asset == "X3"], got[got.asset == "X3"].reset_index(drop=True)
    c = one.close.reset_index(drop=True)
    r = np.log(c).diff()
    for n in (5, 21, 63):
        assert np.allclose(g[f"rv_{n}d"], np.sqrt(252 * r.pow(2).rolling(n).mean()), equal_nan=True)
    assert np.allclose(g["semidev_21d"], np.sqrt(252 * r.clip(upper=0).pow(2).rolling(21).mean()), equal_nan=True)
    assert np.allclose(g["drawdown_252d"], c / c.rolling(252).max() - 1, equal_nan=True)


def test_garman_klass_clips_at_zero(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), 1.0, 1.0001, 0.9999, 2.0, 2.0, 1) for i in range(22)]
    df = spark.createDataFrame(rows, "asset string, trade_date date, open double, high double, low double, close double, adj_close double, volume long")
    assert ft.price_features(df).orderBy(F.desc("trade_date")).first().garman_klass_21d == 0.0


def test_average_pair_correlation_matches_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) + rng.normal(size=(60, 1))
    x[30, 2] = np.nan
    days = pd.bdate_range("2020-01-01", periods=60).date
    long = [(days[i], f"M{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(60) for j in range(4)]
    got = ft.cross_section(spark.createDataFrame(long, "trade_date date, asset string, r double"), 4).orderBy("trade_date").toPandas()
    for i in range(60):
        win = x[i - 20 : i + 1]
        if i < 20 or np.isnan(win).any():
            assert pd.isna(got["sector_avgcorr_21d"][i])
        else:
            c = np.corrcoef(win.T)
            assert got["sector_avgcorr_21d"][i] == pytest.approx(c[np.triu_indices(4, 1)].mean(), rel=1e-9)


def test_point_in_time_against_brute_force(spark, inputs):
    _, monthly = macro_frames()
    # A gap in validity: the newest month is known, lapses, and an older one becomes the latest.
    monthly = pd.concat(
        [monthly, pd.DataFrame([("M1", dt.date(2017, 12, 1), dt.date(2015, 2, 3), dt.date(2015, 2, 9), 7.0)], columns=monthly.columns)]
    )
    dates = [d.date() for d in pd.date_range("2014-01-01", "2016-12-31", freq="5D")]
    spine = spark.createDataFrame([(d,) for d in dates], "as_of_date date")
    got = pit.pit_lagged(spark.createDataFrame(monthly), spine, {"M1": 1, "M2": 12}).toPandas().set_index(["series", "as_of_date"])
    key = lambda d: d.year * 12 + d.month
    for s, lag in (("M1", 1), ("M2", 12)):
        rows = monthly[monthly.series == s]
        for d in dates:
            valid = rows[(rows.valid_from <= d) & (rows.valid_to >= d)]
            if valid.empty:
                assert (s, d) not in got.index
                continue
            best = valid.loc[valid.observation_date.map(key).idxmax()]
            assert got.loc[(s, d), "latest"] == best.value
            old = valid[valid.observation_date.map(key) == key(best.observation_date) - lag]
            have = got.loc[(s, d), "lagged"]
            assert (pd.isna(have) and old.empty) or have == old.value.iloc[0]


def test_daily_lookup_ignores_valid_to_and_takes_last_release(spark):
    rows = [("S", "2020-01-02", "2020-01-03", 1.0), ("S", "2020-01-03", "2020-01-06", 2.0), ("S", "2020-01-04", "2020-01-06", 3.0)]
    v = spark.createDataFrame(rows, "series string, o string, f string, value double").selectExpr(
        "series", "date(o) AS observation_date", "date(f) AS valid_from", "date(f) AS valid_to", "value"
    )
    spine = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-01-08')) AS as_of_date")
    got = {r.as_of_date.day: r.value for r in pit.asof_daily(v, spine).collect()}
    assert got == {3: 1.0, 4: 1.0, 5: 1.0, 6: 3.0, 7: 3.0, 8: 3.0}


def test_rule_lag_known_dates(spark):
    days = {
        "2020-01-03": "2020-01-06",
        "2020-11-25": "2020-11-27",
        "2020-12-31": "2021-01-04",
        "2010-12-30": "2011-01-03",  # New Year's Day on a Saturday is observed on Friday
        "2022-06-17": "2022-06-21",  # Juneteenth on a Sunday
        "2019-06-18": "2019-06-19",
        "2021-12-23": "2021-12-27",
        "2004-06-10": "2004-06-11",
    }
    obs = spark.createDataFrame([("S", d, 1.0) for d in days], "series string, d string, value double").selectExpr(
        "series", "date(d) AS observation_date", "value"
    )
    got = {str(r.observation_date): (str(r.valid_from), str(r.valid_to)) for r in pit.rule_lag(obs).collect()}
    assert got == {d: (v, "9999-12-31") for d, v in days.items()}


def test_labels_against_pandas_and_future_shock(spark, panel_frame):
    target = Target(lookback=60)
    frame = panel_frame[panel_frame.asset == "X2"].reset_index(drop=True)
    got = as_pandas(lb.make_labels(spark.createDataFrame(frame), target))
    r = np.log(frame.close).diff()
    rv = np.sqrt(252 / 5 * r.pow(2).rolling(5).sum().shift(-5))
    thr = rv.shift(5).rolling(60).quantile(0.8)
    assert np.allclose(got.rv_fwd, rv, equal_nan=True) and np.allclose(got.threshold, thr, equal_nan=True)
    valid = rv.notna() & thr.notna()
    assert (got.y.notna() == valid).all() and (got.y[valid] == (rv > thr)[valid].astype(int)).all()
    assert (got.label_known_date[valid].reset_index(drop=True) == frame.trade_date.shift(-5)[valid].reset_index(drop=True)).all()
    shocked = frame.copy()
    shocked.loc[300:, "close"] *= 3
    again = as_pandas(lb.make_labels(spark.createDataFrame(shocked), target))
    pd.testing.assert_frame_equal(got[:294], again[:294], rtol=1e-9)


def test_long_and_wide_keep_finite_values_only(spark):
    df = spark.createDataFrame([("A", 1, 1.0, float("nan")), ("A", 2, float("inf"), None)], "asset string, d int, f double, g double")
    long = sinks.long_values(df, ["asset", "d"], ["f", "g"])
    assert [(r.d, r.name, r.value) for r in long.collect()] == [(1, "f", 1.0)]
    wide = sinks.wide_values(long, ["asset", "d"], ["f", "g"]).collect()
    assert [(r.d, r.f, r.g) for r in wide] == [(1, 1.0, None)]
