from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelvar.functions.ordered import exact_quantiles, running_totals
from panelvar.functions.recursion import ewma_variance, linear_recursion
from panelvar.functions.tails import chi2_sf, normal_multipliers, student_multipliers, t_quantile, t_tail
from panelvar.functions.uniform import MODULUS, mixed


def test_mixed_integers_look_uniform():
    u = mixed(7, np.arange(400)[:, None], 0, np.arange(500)) / MODULUS
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    assert abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.01
    assert 0 <= u.min() and u.max() < 1


def test_distribution_constants():
    assert t_quantile(0.99, 5) == pytest.approx(3.364929998907, rel=1e-9)
    assert t_quantile(0.95, 5) == pytest.approx(2.015048373333, rel=1e-9)
    z, tail = normal_multipliers(0.99)
    assert (z, tail) == (pytest.approx(2.32634787404), pytest.approx(2.66521422034))
    var, es = student_multipliers(0.99, 5)
    assert var == pytest.approx(3.364929998907 / math.sqrt(5 / 3)) and es > var
    # Large degrees of freedom approach the normal tail; one degree is the Cauchy tail.
    assert float(t_tail(np.array([1.96]), np.array([1e6]))[0]) == pytest.approx(0.0249979, abs=1e-6)
    assert float(t_tail(np.array([1.0]), np.array([1.0]))[0]) == pytest.approx(0.25, rel=1e-9)


def test_chi_square_tails(spark):
    row = spark.createDataFrame([(3.841458820694124, 5.991464547107979)], "a double, b double").select(
        chi2_sf(F.col("a"), 1).alias("p1"), chi2_sf(F.col("b"), 2).alias("p2")
    ).first()
    assert row.p1 == pytest.approx(0.05, rel=1e-9) and row.p2 == pytest.approx(0.05, rel=1e-9)


@pytest.mark.parametrize("rho", [0.0, 0.3, 0.94, 0.9999])
def test_linear_recursion_matches_a_loop(spark, rho):
    rng = np.random.default_rng(1)
    e = rng.exponential(1.0, 300)
    df = spark.createDataFrame(pd.DataFrame({"asset": "A", "trade_date": np.arange(300), "e": e}))
    got = [r.s for r in linear_recursion(df, ["asset"], "trade_date", rho, "e", "s").orderBy("trade_date").collect()]
    want, s = [], 0.0
    for x in e:
        s = rho * s + x
        want.append(s)
    assert np.allclose(got, want, rtol=1e-11)


def test_ewma_starts_at_first_square(spark):
    r = [None, 0.02, -0.01, 0.03]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(r)], "asset string, trade_date int, r double")
    got = [x.ewma_var for x in ewma_variance(df, 0.94).orderBy("trade_date").collect()]
    s = 0.02**2
    want = [None, s, 0.94 * s + 0.06 * 0.01**2]
    want.append(0.94 * want[2] + 0.06 * 0.03**2)
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_ordered_sums_and_quantiles_match_brute_force(spark):
    rng = np.random.default_rng(3)
    # One dominant group, heavy ties, and a constant group.
    frame = pd.concat(
        [
            pd.DataFrame({"g": "big", "v": np.round(rng.gamma(2.0, 1.0, 4000), 2)}),
            pd.DataFrame({"g": "small", "v": rng.normal(size=7)}),
            pd.DataFrame({"g": "flat", "v": [0.25] * 50}),
        ]
    )
    df = spark.createDataFrame(frame)
    counts = df.groupBy("g", "v").count()
    got = running_totals(counts, ["g"], "v", ["count"], descending=True).toPandas()
    for name, part in got.groupby("g"):
        part = part.sort_values("v", ascending=False)
        assert (part["cum_count"].to_numpy() == part["count"].cumsum().to_numpy()).all(), name
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    exact = exact_quantiles(df, ["g"], "v", qs).toPandas().set_index(["g", "q"])["quantile"]
    for name, part in frame.groupby("g"):
        for q in qs:
            assert exact[name, q] == pytest.approx(np.quantile(part["v"], q), abs=1e-12), (name, q)


def test_ewma_ages_over_gaps(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, 300)
    r[[0, 1, 50, 51, 52, 130, 131, 200]] = np.nan
    days = pd.bdate_range("2014-01-01", periods=300).date
    df = spark.createDataFrame([("A", d, None if np.isnan(x) else float(x)) for d, x in zip(days, r)], "asset string, trade_date date, r double")
    got = np.array([x.ewma_var for x in ewma_variance(df, 0.94).orderBy("trade_date").collect()], float)
    want = (pd.Series(r) ** 2).ewm(alpha=0.06, adjust=False).mean().to_numpy()
    assert np.allclose(got, want, rtol=1e-10, equal_nan=True)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4096, 4161, 40_000])
def test_linear_recursion_of_long_series_in_one_pass_without_lists(spark, n):
    """Two series, decays that change by row; 40,000 rows are more than three levels of the scan."""
    rho = [0.999, 0.5, 1.0, 0.2][:4]
    rows = spark.range(2 * n).selectExpr(
        "id % 2 AS asset", "id div 2 AS k", f"element_at(array({', '.join(map(str, rho))}), cast(id div 2 % 4 AS int) + 1) AS rho", "sin(id) AS e"
    )
    out = linear_recursion(rows.withColumnRenamed("k", "trade_date"), ["asset"], "trade_date", F.col("rho"), "e", "s")
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.asset, r.trade_date): r.s for r in out.select("asset", "trade_date", "s").collect()}
    assert len(got) == 2 * n
    for asset in (0, 1):
        s = 0.0
        for k in range(n):
            s = rho[k % 4] * s + math.sin(2 * k + asset)
            assert got[asset, k] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_linear_recursion_without_decay_sums_up(spark):
    """A decay of one keeps every map's product at one over all levels."""
    out = linear_recursion(spark.range(10_000).selectExpr("0 AS asset", "id", "1.0D AS e"), ["asset"], "id", 1.0, "e", "s")
    assert out.where("abs(s - (id + 1)) > 1e-6").isEmpty()
