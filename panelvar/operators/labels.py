"""Forward-volatility labels.

A label looks h rows ahead. The threshold of a day therefore stops h rows short of it: later
forward volatilities were not complete on that day.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import by_asset, ln
from ..settings import Target


def log_returns(prices: DataFrame, steps: tuple[int, ...] = (1,), price: str = "close") -> DataFrame:
    """Adds ``ret_{k}d`` for each step; all steps share one sort."""
    w = by_asset()
    lc = prices.withColumn("lc", ln(F.col(price)))
    return lc.withColumns({f"ret_{k}d": F.col("lc") - F.lag("lc", k).over(w) for k in steps}).drop("lc")


def simple_returns(prices: DataFrame, price: str = "adj_close") -> DataFrame:
    """(asset, trade_date, r) simple daily returns; the first row of an asset has a NULL."""
    w = by_asset()
    p = F.col(price)
    return prices.select("asset", "trade_date", (F.try_divide(p, F.lag(p).over(w)) - 1).alias("r"))


def forward_realized_vol(returns: DataFrame, target: Target, ret: str = "ret_1d") -> DataFrame:
    """Adds ``rv_fwd``: annualised volatility of the next ``horizon`` rows, NULL where incomplete."""
    h = target.horizon
    ahead = f"OVER (PARTITION BY asset ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    scale = f"{target.trading_days / h}D"
    return returns.selectExpr(
        "*", f"CASE WHEN count({ret}) {ahead} = {h} THEN sqrt({scale} * sum(pow({ret}, 2)) {ahead}) END AS rv_fwd"
    )


def make_labels(prices: DataFrame, target: Target = Target()) -> DataFrame:
    """(asset, as_of_date, rv_fwd, threshold, y, label_known_date, label_name)."""
    w = "PARTITION BY asset ORDER BY trade_date"
    h, n = target.horizon, target.lookback
    rv = forward_realized_vol(log_returns(prices).select("asset", "trade_date", "ret_1d"), target)
    seen = rv.selectExpr(
        "*",
        f"lag(rv_fwd, {h}) OVER ({w}) AS seen",
        f"lead(trade_date, {h}) OVER ({w}) AS known",
    )
    # Sorted once per row; the quantile reads two neighbouring elements.
    past = seen.selectExpr(
        "asset",
        "trade_date",
        "rv_fwd",
        "known",
        f"sort_array(collect_list(seen) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) AS past",
    )
    pos = target.quantile * (n - 1)
    low = math.floor(pos)
    a, b = f"past[{low}]", f"past[{min(low + 1, n - 1)}]"
    cut = past.selectExpr("*", f"CASE WHEN size(past) = {n} THEN {a} + ({b} - {a}) * {pos - low}D END AS threshold")
    valid = "rv_fwd IS NOT NULL AND threshold IS NOT NULL"
    return cut.selectExpr(
        "asset",
        "trade_date AS as_of_date",
        "rv_fwd",
        "threshold",
        f"CASE WHEN {valid} THEN cast(rv_fwd > threshold AS int) END AS y",
        f"CASE WHEN {valid} THEN known END AS label_known_date",
        f"'{target.label_name}' AS label_name",
    )


def label_definition(spark, target: Target = Target()) -> DataFrame:
    return spark.createDataFrame(
        [(target.label_name, 1, target.horizon, target.quantile, target.lookback)],
        "name string, version int, horizon_days int, threshold_quantile double, threshold_lookback_obs int",
    )
