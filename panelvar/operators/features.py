"""Feature set of the panel.

Own-price features come from one window specification per asset, so they share one exchange and one
sort. Market-wide series (implied volatility, rates, macro, cross-section) are reduced to one row
per date first; that table is bounded by the calendar and is joined to every asset on the date.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import clip
from ..session import pin
from ..settings import LOG_FEATURES, LOG_FLOOR, TRADING_DAYS, PanelRoles
from .pit import asof_daily, pit_lagged


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    lookback: int
    formula: str
    extended: bool = False


# The feature registry (names, look-back in rows, formula text).
REGISTRY: tuple[Feature, ...] = (
    Feature("ret_1d", "returns", 1, "ln(C_t / C_{t-1})"),
    Feature("ret_5d", "returns", 5, "ln(C_t / C_{t-5})"),
    Feature("ret_21d", "returns", 21, "ln(C_t / C_{t-21})"),
    Feature("ret_63d", "returns", 63, "ln(C_t / C_{t-63})"),
    Feature("rv_5d", "backward_vol", 5, "sqrt(252 * mean(r^2, 5))"),
    Feature("rv_21d", "backward_vol", 21, "sqrt(252 * mean(r^2, 21))"),
    Feature("rv_63d", "backward_vol", 63, "sqrt(252 * mean(r^2, 63))"),
    Feature("semidev_21d", "downside", 21, "sqrt(252 * mean(min(r,0)^2, 21))"),
    Feature("drawdown_252d", "downside", 252, "C_t / max(C, 252) - 1"),
    Feature("parkinson_21d", "range_vol", 21, "sqrt(252/(4 ln2) * mean(ln(H/L)^2, 21))"),
    Feature("garman_klass_21d", "range_vol", 21, "sqrt(252 * mean(0.5 ln(H/L)^2 - (2 ln2 - 1) ln(C/O)^2, 21))"),
    Feature("vix_level", "implied_vol", 0, "VIX_t"),
    Feature("vix_chg_1d", "implied_vol", 1, "VIX_t - VIX_{t-1}"),
    Feature("vix_chg_5d", "implied_vol", 5, "VIX_t - VIX_{t-5}"),
    Feature("vrp_proxy", "implied_vol", 21, "VIX_t/100 - rv_21d"),
    Feature("spy_volume_ratio_21d", "volume", 21, "ln(V_t / mean(V, 21))"),
    Feature("dff_chg_21d", "rates", 21, "DFF_known_t - DFF_known_{t-21}"),
    Feature("dgs10_chg_5d", "rates", 5, "DGS10_known_t - DGS10_known_{t-5}"),
    Feature("dgs10_chg_21d", "rates", 21, "DGS10_known_t - DGS10_known_{t-21}"),
    Feature("dgs2_chg_5d", "rates", 5, "DGS2_known_t - DGS2_known_{t-5}"),
    Feature("t10y2y_level", "rates", 0, "T10Y2Y_known_t"),
    Feature("unrate_chg_1m", "macro", 0, "UNRATE_latest - UNRATE_prev (same snapshot)"),
    Feature("cpi_yoy", "macro", 0, "CPI_latest / CPI_12m_earlier - 1 (same snapshot)"),
    Feature("sector_dispersion_1d", "cross_section", 1, "std_i(r_i,t)"),
    Feature("sector_avgcorr_21d", "cross_section", 21, "mean_{i<j} corr(r_i, r_j; 21)"),
    Feature("hyg_lqd_chg_5d", "credit", 5, "ln(HYG/LQD)_t - ln(HYG/LQD)_{t-5}", True),
)
ALL_FEATURES = tuple(f.name for f in REGISTRY)
BASE_FEATURES = tuple(f.name for f in REGISTRY if not f.extended)
PRICE_FEATURES = ALL_FEATURES[:11]


def registry_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(f.name, 1, f.group, f.lookback, f.formula, f.extended) for f in REGISTRY],
        "name string, version int, feature_group string, lookback_days int, formula string, extended boolean",
    )


def feature_sets(registry: DataFrame) -> DataFrame:
    """(set_name, name) membership: the base set, and the extended set that adds to it."""
    sets = F.when(F.col("extended"), F.array(F.lit("extended"))).otherwise(
        F.array(F.lit("base"), F.lit("extended"))
    )
    return registry.select(F.explode(sets).alias("set_name"), "name")


# Expressions below are SQL text: a wide projection is then one call instead of hundreds of nodes.
_W = "PARTITION BY asset ORDER BY trade_date"
_TO_DATE = f"OVER ({_W} ROWS UNBOUNDED PRECEDING)"


def _lag(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER ({_W})"


def _frame(n: int) -> str:
    return f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _filled(count: str, n: int) -> str:
    """True where the last ``n`` rows all carry a value, from a running count of values."""
    return f"({count} - coalesce({_lag(count, n)}, 0) = {n})"


def price_features(prices: DataFrame) -> DataFrame:
    """Own-price features of every asset, next to the input columns.

    Frames stay short: sums over 63 rows and highs over 252 rows are put together from 21-row pieces
    (3 and 12 of them), and completeness comes from running counts rather than from more frames.
    """
    logs = prices.selectExpr(
        "*",
        "CASE WHEN close > 0 THEN ln(close) END AS lc",
        "CASE WHEN high > 0 AND low > 0 THEN pow(ln(high / low), 2) END AS range2",
        "CASE WHEN high > 0 AND low > 0 AND close > 0 AND open > 0 THEN "
        f"0.5D * pow(ln(high / low), 2) - {2 * math.log(2) - 1}D * pow(ln(close / open), 2) END AS gk",
    )
    returns = logs.selectExpr("*", *[f"lc - {_lag('lc', k)} AS ret_{k}d" for k in (1, 5, 21, 63)])
    squares = returns.selectExpr(
        "*",
        "pow(ret_1d, 2) AS r2",
        "CASE WHEN ret_1d IS NOT NULL THEN pow(least(ret_1d, 0.0D), 2) END AS down2",
        f"count(ret_1d) {_TO_DATE} AS n_r",
        f"count(close) {_TO_DATE} AS n_c",
        f"count(range2) {_TO_DATE} AS n_h",
        f"count(gk) {_TO_DATE} AS n_g",
    )
    pieces = squares.selectExpr(
        "*",
        f"CASE WHEN {_filled('n_r', 5)} THEN sum(r2) {_frame(5)} END AS s5",
        f"CASE WHEN {_filled('n_r', 21)} THEN sum(r2) {_frame(21)} END AS s21",
        f"CASE WHEN {_filled('n_r', 21)} THEN sum(down2) {_frame(21)} END AS d21",
        f"CASE WHEN {_filled('n_h', 21)} THEN sum(range2) {_frame(21)} END AS h21",
        f"CASE WHEN {_filled('n_g', 21)} THEN sum(gk) {_frame(21)} END AS g21",
        f"max(close) {_frame(21)} AS high21",
        f"{_filled('n_c', 252)} AS year_filled",
    )
    year_high = ", ".join(["high21", *[_lag("high21", 21 * i) for i in range(1, 12)]])
    td = f"{float(TRADING_DAYS)}D"
    return pieces.selectExpr(
        *prices.columns,
        *[f"ret_{k}d" for k in (1, 5, 21, 63)],
        f"sqrt({td} * s5 / 5) AS rv_5d",
        f"sqrt({td} * s21 / 21) AS rv_21d",
        f"sqrt({td} * (s21 + {_lag('s21', 21)} + {_lag('s21', 42)}) / 63) AS rv_63d",
        f"sqrt({td} * d21 / 21) AS semidev_21d",
        f"CASE WHEN year_filled THEN try_divide(close, greatest({year_high})) - 1 END AS drawdown_252d",
        f"sqrt({TRADING_DAYS / (4 * math.log(2))}D * h21 / 21) AS parkinson_21d",
        f"CASE WHEN g21 IS NOT NULL THEN sqrt({td} * greatest(g21 / 21, 0.0D)) END AS garman_klass_21d",
    )


def member_returns(market: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """Log returns of the members on the market's own dates; a gap in a member leaves a NULL.

    Returns (trade_date, asset, r) with one row per market date and member.
    """
    names = ", ".join(f"'{m}'" for m in members)
    levels = market.where("on_market = 1").selectExpr("trade_date", "levels", f"explode(array({names})) AS asset")
    logs = levels.selectExpr("trade_date", "asset", "try_element_at(levels, asset) AS p").selectExpr(
        "trade_date", "asset", "CASE WHEN p > 0 THEN ln(p) END AS lc"
    )
    return logs.selectExpr("trade_date", "asset", f"lc - {_lag('lc', 1)} AS r")


def cross_section(returns: DataFrame, n_members: int, window: int = 21) -> DataFrame:
    """Per date: sample deviation over the members, and their mean pairwise correlation.

    The deviation needs all members present. For the correlation no pair is ever formed: with every
    member standardised inside the trailing window, the correlations of all ordered pairs add up to
    the sum over days of (sum over members)^2, so a date needs ``window`` sums and work is linear in
    the number of members. A gap or a constant member inside the window gives NULL.
    """
    local = returns.selectExpr(
        "trade_date",
        "r",
        f"collect_list(r) {_frame(window)} AS x",
        f"avg(r) {_frame(window)} AS mean",
    ).selectExpr(
        "trade_date", "r", f"CASE WHEN size(x) = {window} THEN transform(x, v -> v - mean) END AS c"
    )
    z = local.selectExpr("trade_date", "r", "c", "sqrt(aggregate(c, 0.0D, (s, v) -> s + v * v)) AS norm").selectExpr(
        "trade_date", "r", "CASE WHEN norm > 0 THEN transform(c, v -> v / norm) END AS z"
    )
    sums = z.groupBy("trade_date").agg(
        F.expr("count(z) AS k"),
        F.expr(f"CASE WHEN count(r) = {n_members} THEN stddev_samp(r) END AS sector_dispersion_1d"),
        *[F.expr(f"sum(z[{j}]) AS s{j}") for j in range(window)],
    )
    total = " + ".join(f"s{j} * s{j}" for j in range(window))
    pairs = n_members * (n_members - 1)
    return sums.selectExpr(
        "trade_date",
        "sector_dispersion_1d",
        f"CASE WHEN k = {n_members} THEN ({total} - {n_members}) / {pairs} END AS sector_avgcorr_21d",
    )


def market_series(prices: DataFrame, roles: PanelRoles, implied_scale: float = 1.0) -> DataFrame:
    """One row per date with every price series that serves all assets, from one scan of the prices.

    ``levels`` maps each sector member to its adjusted close (as many entries as configured members).
    """

    def pick(asset: str, col: str) -> str:
        return f"max(CASE WHEN asset = '{asset}' THEN {col} END)"

    names = ", ".join(f"'{m}'" for m in roles.sector)
    spread = f"try_divide({pick(roles.credit[0], 'adj_close')}, {pick(roles.credit[1], 'adj_close')})"
    return prices.groupBy("trade_date").agg(
        F.expr(f"max(CASE WHEN asset = '{roles.market}' THEN 1 END) AS on_market"),
        F.expr(f"{pick(roles.implied_vol, 'close')} / {float(implied_scale)}D AS vix"),
        F.expr(f"cast({pick(roles.volume, 'volume')} AS double) AS mkt_volume"),
        F.expr(f"CASE WHEN {spread} > 0 THEN ln({spread}) END AS credit"),
        F.expr(f"map_from_entries(collect_list(CASE WHEN asset IN ({names}) THEN struct(asset, adj_close) END)) AS levels"),
    )


def macro_levels(daily: DataFrame, dates: DataFrame, roles: PanelRoles) -> DataFrame:
    """One row per date with the daily rates known at its close."""
    levels = {"dff": roles.policy_rate, "d10": roles.ten_year, "d2": roles.two_year, "spread": roles.term_spread}
    known = asof_daily(daily.where(F.col("series").isin(*levels.values())), dates)
    return known.groupBy("as_of_date").agg(
        *[F.expr(f"max(CASE WHEN series = '{s}' THEN value END) AS {c}") for c, s in levels.items()]
    )


def macro_snapshots(monthly: DataFrame, dates: DataFrame, roles: PanelRoles) -> DataFrame:
    """One row per date with the month-over-month and year-over-year changes of one snapshot."""
    lagged = pit_lagged(monthly, dates, {roles.unemployment: 1, roles.price_index: 12})
    return lagged.groupBy("as_of_date").agg(
        F.expr(f"max(CASE WHEN series = '{roles.unemployment}' THEN latest - lagged END) AS unrate_chg_1m"),
        F.expr(f"max(CASE WHEN series = '{roles.price_index}' THEN try_divide(latest, lagged) - 1 END) AS cpi_yoy"),
    )


_RATES = ("dff_chg_21d", "dgs10_chg_5d", "dgs10_chg_21d", "dgs2_chg_5d", "t10y2y_level")
_SNAPSHOT = ("unrate_chg_1m", "cpi_yoy")
_CROSS = ("sector_dispersion_1d", "sector_avgcorr_21d")


def compute_features(
    prices: DataFrame,
    daily: DataFrame,
    monthly: DataFrame,
    roles: PanelRoles,
    implied_scale: float = 1.0,
    names: tuple[str, ...] = ALL_FEATURES,
) -> DataFrame:
    """(asset, as_of_date, features) for every asset; branches that no name needs are not built."""
    # Calendar-sized and read by several branches, so it is written once and read back.
    market = pin(market_series(prices, roles, implied_scale))
    dates = market.select(F.col("trade_date").alias("as_of_date"))
    shared = market.drop("on_market", "levels")

    def needs(group: tuple[str, ...]) -> bool:
        return bool(set(group) & set(names))

    if needs(_RATES):
        shared = shared.join(macro_levels(daily, dates, roles).withColumnRenamed("as_of_date", "trade_date"), "trade_date", "left")
    if needs(_SNAPSHOT):
        snap = macro_snapshots(monthly, dates, roles).withColumnRenamed("as_of_date", "trade_date")
        shared = shared.join(snap, "trade_date", "left")
    if needs(_CROSS):
        shared = shared.join(cross_section(member_returns(market, roles.sector), len(roles.sector)), "trade_date", "left")
    # At most one row per calendar day, whatever the size of the panel: a bounded broadcast.
    joined = price_features(prices).join(F.broadcast(shared), "trade_date", "left")
    derived = {
        "vix_level": "vix",
        "vix_chg_1d": f"vix - {_lag('vix', 1)}",
        "vix_chg_5d": f"vix - {_lag('vix', 5)}",
        "vrp_proxy": "vix / 100 - rv_21d",
        "spy_volume_ratio_21d": (
            f"CASE WHEN count(mkt_volume) {_frame(21)} = 21 AND mkt_volume > 0 "
            f"THEN ln(mkt_volume / avg(mkt_volume) {_frame(21)}) END"
        ),
        "dff_chg_21d": f"dff - {_lag('dff', 21)}",
        "dgs10_chg_5d": f"d10 - {_lag('d10', 5)}",
        "dgs10_chg_21d": f"d10 - {_lag('d10', 21)}",
        "dgs2_chg_5d": f"d2 - {_lag('d2', 5)}",
        "t10y2y_level": "spread",
        "hyg_lqd_chg_5d": f"credit - {_lag('credit', 5)}",
    }
    wide = joined.selectExpr("asset", "trade_date AS as_of_date", *[f"{derived.get(c, c)} AS {c}" for c in names])
    return wide.selectExpr(
        "asset", "as_of_date", *[f"CASE WHEN abs({c}) < double('inf') THEN {c} END AS {c}" for c in names]
    )


def modeling_frame(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features joined to labels; both sides are keyed by asset, so the join follows their layout."""
    return features.join(labels, ["asset", "as_of_date"], "inner")


def design_matrix(frame: DataFrame, features: tuple[str, ...] | list[str]) -> DataFrame:
    """Log of the volatility-type columns (floored), other columns as they are."""
    return frame.withColumns(
        {c: F.log(clip(F.col(c), low=LOG_FLOOR)) for c in features if c in LOG_FEATURES}
    )

