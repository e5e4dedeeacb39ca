"""Covariances of many assets by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelvar.operators import risk


def long_returns(k: int, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (n, k)) + rng.normal(0, 0.01, (n, 1))
    frame = pd.DataFrame(x, index=pd.bdate_range("2020-01-01", periods=n).date, columns=[f"N{i:04d}" for i in range(k)])
    return frame.rename_axis("trade_date").reset_index().melt("trade_date", var_name="asset", value_name="r")


def run(spark, rows: pd.DataFrame, block: int):
    df = spark.createDataFrame(rows)
    return risk.covariance_blocks(df, df.select("asset").distinct(), block)


def test_every_pair_of_many_assets(spark):
    rows = long_returns(300, 40)
    hole = rows[~((rows.asset == "N0007") & (rows.trade_date == rows.trade_date[5]))]  # that day is left out for all
    got = run(spark, hole, 64).toPandas().pivot(index="asset_i", columns="asset_j", values="cov")
    wide = hole.pivot(index="trade_date", columns="asset", values="r").dropna()
    assert len(wide) == 39 and got.shape == (300, 300)
    np.testing.assert_allclose(got, wide.cov(), atol=1e-15)


def test_one_asset_one_day_and_none(spark):
    one = run(spark, long_returns(1, 12), 64).collect()
    assert len(one) == 1 and one[0].asset_i == one[0].asset_j == "N0000" and one[0]["cov"] > 0
    assert [r["cov"] for r in run(spark, long_returns(3, 1), 2).collect()] == [None] * 9
    three = spark.createDataFrame(long_returns(3, 4))
    names = three.select("asset").distinct()
    silent = three.withColumn("r", F.when(F.col("asset") != "N0001", F.col("r")))
    assert risk.covariance_blocks(silent, names, 2).count() == 0
