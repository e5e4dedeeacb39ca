"""Exposure overlay: weights from volatility targets and probabilities, backtest net of costs.

An exposure decided at the close of day t is applied ``lag`` rows later; uninvested capital earns the
cash rate known the day before; turnover in the held weight is charged. Strategies are columns of one
row per (asset, date), so every strategy shares the same windows and the same common days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import compounded
from ..functions.recursion import ewma_variance
from ..settings import TRADING_DAYS, DateWindow, OverlaySettings
from .risk import max_drawdown, tail_means, with_drawdown
from .splits import in_windows

BASELINES = ("buy_hold", "static_matched", "ewma_vol_target", "vix_target")


def market_inputs(returns: DataFrame, implied: DataFrame, cash: DataFrame, probs: DataFrame, models: Sequence[str], decay: float) -> DataFrame:
    """(asset, trade_date, r, ewma_vol, vix, cash, p_{model}...) on each asset's own dates.

    ``implied`` is (trade_date, vix); ``cash`` is per asset and date; ``probs`` is long predictions.
    """
    wide = (
        probs.where(F.col("model").isin(*models))
        .groupBy("asset", F.col("as_of_date").alias("trade_date"))
        .agg(*[F.expr(f"max(CASE WHEN model = '{m}' THEN prob END) AS p_{m}") for m in models])
    )
    # The implied series has one row per calendar day at most: a bounded broadcast.
    return (
        ewma_variance(returns, decay)
        .selectExpr("asset", "trade_date", "r", f"sqrt({TRADING_DAYS} * ewma_var) AS ewma_vol")
        .join(F.broadcast(implied), "trade_date", "left")
        .join(cash, ["asset", "trade_date"], "left")
        .join(wide, ["asset", "trade_date"], "left")
    )


def _capped(value: str, cap: float) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, 0.0D), {float(cap)}D) END"


def _target(vol: str, target_vol: str, cap: float) -> str:
    return f"CASE WHEN {vol} = 0 THEN {float(cap)}D ELSE {_capped(f'try_divide({target_vol}, {vol})', cap)} END"


def build_weights(inputs: DataFrame, models: Sequence[str], target_vol: str | float, cap: float = 1.0) -> DataFrame:
    """Adds w_{strategy}: exposure decided at the close, within [0, cap].

    ``target_vol`` is a number or a column name. A volatility of zero asks for the full cap.
    """
    tv = f"{target_vol}D" if isinstance(target_vol, (int, float)) else target_vol
    return inputs.selectExpr(
        "*",
        "1.0D AS w_buy_hold",
        f"{_target('ewma_vol', tv, cap)} AS w_ewma_vol_target",
        f"{_target('(vix / 100)', tv, cap)} AS w_vix_target",
        *[f"{_capped(f'1 - p_{m}', cap)} AS w_model_{m}" for m in models],
    )


def run_backtest(
    weighted: DataFrame,
    models: Sequence[str],
    lag: str | int,
    cost_bps: str | float,
    start: date,
    end: date,
    static_from: str,
    scenario: Sequence[str] = (),
    lags: Sequence[int] = (),
) -> DataFrame:
    """(scenario..., asset, trade_date, cash, strategy, held, turnover, net).

    Days count when every strategy, the return and the cash rate are present. Lag and cost are
    numbers or, for a sensitivity run, columns constant within a scenario; ``lags`` then names every
    lag that the column holds.
    """
    names = ["buy_hold", "ewma_vol_target", "vix_target", *[f"model_{m}" for m in models]]
    keys = ", ".join([*scenario, "asset"])
    w = f"PARTITION BY {keys} ORDER BY trade_date"
    lags = [lag] if isinstance(lag, int) else sorted(set(lags))
    if not lags:
        raise ValueError("a lag column needs the list of its lags")

    def held(name: str) -> str:
        options = {k: f"lag(w_{name}, {k}) OVER ({w})" for k in lags}
        if isinstance(lag, int):
            return options[lag]
        return "CASE " + " ".join(f"WHEN {lag} = {k} THEN {x}" for k, x in options.items()) + " END"

    cost = f"{float(cost_bps)}D" if isinstance(cost_bps, (int, float)) else cost_bps
    applied = weighted.selectExpr(
        *scenario, "asset", "trade_date", "r", "cash", f"{cost} AS cost", *[f"{held(n)} AS h_{n}" for n in names]
    )
    window = (F.col("trade_date") >= F.lit(start)) & (F.col("trade_date") <= F.lit(end))
    common = applied.where(window).dropna(subset=["r", "cash", *[f"h_{n}" for n in names]])
    matched = common.selectExpr("*", f"avg(h_{static_from}) OVER (PARTITION BY {keys}) AS h_static_matched")
    ordered = [*BASELINES, *[f"model_{m}" for m in models]]
    turned = matched.selectExpr(
        "*", *[f"abs(h_{n} - coalesce(lag(h_{n}) OVER ({w}), 0.0D)) AS t_{n}" for n in ordered]
    )
    entries = ", ".join(
        f"struct('{n}' AS strategy, h_{n} AS held, t_{n} AS turnover, "
        f"h_{n} * r + (1 - h_{n}) * cash - t_{n} * cost / 10000 AS net)"
        for n in ordered
    )
    return turned.selectExpr(*scenario, "asset", "trade_date", "cash", f"inline(array({entries}))")


def performance(bt: DataFrame, keys: Sequence[str] = ("asset", "strategy")) -> DataFrame:
    """Return, volatility, Sharpe, drawdown, Calmar, tail mean, exposure and turnover per series."""
    keys = list(keys)
    td = TRADING_DAYS
    base = (
        with_drawdown(bt, keys, "net")
        .groupBy(*keys)
        .agg(
            F.expr("count(*) AS days"),
            (F.pow(F.product(1 + F.col("net")), F.lit(float(td)) / F.count("*")) - 1).alias("ann_return"),
            F.expr(f"stddev_samp(net) * sqrt({td}) AS ann_vol"),
            F.expr(f"try_divide(avg(net - cash), stddev_samp(net - cash)) * sqrt({td}) AS sharpe"),
            max_drawdown(),
            F.expr("avg(held) AS avg_exposure"),
            F.expr(f"sum(turnover) / (count(*) / {float(td)}D) AS turnover_per_year"),
        )
    )
    tails = tail_means(bt, keys, "net", {"05": 0.05}).select(*keys, F.col("m_05").alias("cvar95_daily"))
    calmar = F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown"))
    return base.join(tails, keys).withColumn("calmar", calmar)


def episode_table(bt: DataFrame, episodes: Sequence[DateWindow]) -> DataFrame:
    """(asset, strategy) rows with total return and drawdown per declared episode as columns."""
    keys = ["asset", "strategy", "episode"]
    rows = with_drawdown(in_windows(bt, episodes, "trade_date", "episode"), keys, "net")
    stats = rows.groupBy(*keys).agg(compounded(F.col("net")).alias("total_return"), max_drawdown())
    names = [e.name for e in episodes]
    return stats.groupBy("asset", "strategy").agg(
        *[F.expr(f"max(CASE WHEN episode = '{n}' THEN {c} END) AS {n}_{c}") for n in names for c in ("total_return", "max_drawdown")]
    )


def excess_returns(bt: DataFrame) -> DataFrame:
    return bt.selectExpr("asset", "trade_date", "strategy", "net - cash AS x")


def sensitivity(
    inputs: DataFrame, models: Sequence[str], start: date, end: date, static_from: str, s: OverlaySettings = OverlaySettings()
) -> DataFrame:
    """Net Sharpe per strategy for every (lag, cost, target volatility).

    Rows are copied per lag only. Target volatilities are columns of the same windows, and costs enter
    after the aggregation, which is one job for the whole grid.
    """
    lags = ", ".join(str(k) for k in sorted(set(s.lags)))
    w = "PARTITION BY lag, asset ORDER BY trade_date"
    shapes = [("buy_hold", "NULL", "1.0D")]
    for tv in s.target_vols:
        shapes.append(("ewma_vol_target", f"{float(tv)}D", _target("ewma_vol", f"{float(tv)}D", s.max_weight)))
        shapes.append(("vix_target", f"{float(tv)}D", _target("(vix / 100)", f"{float(tv)}D", s.max_weight)))
    shapes += [(f"model_{m}", "NULL", _capped(f"1 - p_{m}", s.max_weight)) for m in models]
    matched = [("static_matched", tv, f"h{i}") for i, (name, tv, _) in enumerate(shapes) if name == static_from]
    count = len(shapes)

    rows = inputs.selectExpr("*", f"explode(array({lags})) AS lag")
    rows = rows.selectExpr("lag", "asset", "trade_date", "r", "cash", *[f"{x} AS w{i}" for i, (_, _, x) in enumerate(shapes)])
    held = [
        "CASE " + " ".join(f"WHEN lag = {k} THEN lag(w{i}, {k}) OVER ({w})" for k in sorted(set(s.lags))) + f" END AS h{i}"
        for i in range(count)
    ]
    inside = (F.col("trade_date") >= F.lit(start)) & (F.col("trade_date") <= F.lit(end))
    common = rows.selectExpr("lag", "asset", "trade_date", "r", "cash", *held).where(inside).dropna()
    for i, (_, _, h) in enumerate(matched, count):
        common = common.withColumn(f"h{i}", F.expr(f"avg({h}) OVER (PARTITION BY lag, asset)"))
    series = [*shapes, *matched]
    turned = common.selectExpr(
        "*", *[f"abs(h{i} - coalesce(lag(h{i}) OVER ({w}), 0.0D)) / 10000 AS t{i}" for i in range(len(series))]
    )
    # Excess over cash is x - cost * t, so its mean and variance at any cost follow from five moments.
    moments = ", ".join(
        f"struct('{name}' AS strategy, CAST({tv} AS DOUBLE) AS tv, avg(h{i} * (r - cash)) AS mx, avg(t{i}) AS mt, "
        f"var_samp(h{i} * (r - cash)) AS vx, var_samp(t{i}) AS vt, covar_samp(h{i} * (r - cash), t{i}) AS c)"
        for i, (name, tv, _) in enumerate(series)
    )
    found = turned.groupBy("lag", "asset").agg(F.expr(f"array({moments}) AS m")).selectExpr("lag", "asset", "inline(m)")
    costs = ", ".join(f"{float(c)}D" for c in s.costs_bps)
    vols = ", ".join(f"{float(tv)}D" for tv in s.target_vols)
    out = found.selectExpr("*", f"explode(array({costs})) AS cost_bps")
    out = out.selectExpr("*", f"explode(CASE WHEN tv IS NULL THEN array({vols}) ELSE array(tv) END) AS target_vol")
    spread = "sqrt(greatest(vx - 2 * cost_bps * c + cost_bps * cost_bps * vt, 0.0D))"
    return out.selectExpr(
        *("lag", "cost_bps", "target_vol", "asset", "strategy"),
        f"try_divide(mx - cost_bps * mt, {spread}) * sqrt({TRADING_DAYS}) AS sharpe",
    )
