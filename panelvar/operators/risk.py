"""One-day VaR and expected shortfall, simulation, backtests and stress scenarios.

VaR and ES are positive losses on the day they apply to, from information through the day before.
A series (asset or portfolio) is one window partition and is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_asset, compounded, ratio
from ..functions.recursion import ewma_variance
from ..functions.tails import chi2_sf, normal_multipliers, student_multipliers
from ..functions.uniform import advance, mixed, scaled
from ..settings import DateWindow, RiskSettings
from .garch import fit_gjr, next_variance, return_arrays, settled, variance_path
from .splits import in_windows

ESTIMATE = ("asset", "trade_date", "method", "conf", "var", "es")


def rolling_tails(x: np.ndarray, window: int, confs: Sequence[float], rows: int = 4096) -> np.ndarray:
    """(len(x) - window, confs, 2): quantile of the previous ``window`` values and the mean up to it.

    Only the smallest values of a window are selected, never a full sort, in slices of rows.
    """
    views = np.lib.stride_tricks.sliding_window_view(x, window)[: len(x) - window]
    out = np.empty((len(views), len(confs), 2))
    places = [(1 - c) * (window - 1) for c in confs]
    needed = sorted({k for p in places for k in (int(p), min(int(p) + 1, window - 1))})
    for at in range(0, len(views), rows):
        part = np.partition(views[at : at + rows], needed, axis=1)
        for i, place in enumerate(places):
            k = int(place)
            low, high = part[:, k], part[:, min(k + 1, window - 1)]
            cut = low + (high - low) * (place - k)
            within = part <= cut[:, None]
            out[at : at + rows, i, 0] = cut
            out[at : at + rows, i, 1] = np.where(within, part, 0.0).sum(axis=1) / within.sum(axis=1)
    return out


def _rolling_estimates(
    rows: DataFrame, keys: Sequence[str], value: str, confs: Sequence[float], window: int, scale: str, method: str
) -> DataFrame:
    """Rolling tails of each series, in Arrow batches: one group is one calendar-bounded series.

    ``scale`` turns the tail of ``value`` into a loss; rows without a full window are left out.
    """

    def series(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trade_date")
        if len(frame) <= window:
            return pd.DataFrame({c: [] for c in (*keys, "trade_date", "conf", "var", "es")})
        tails = rolling_tails(frame["v"].to_numpy(float), window, confs)
        late = frame.iloc[window:]
        loss = -late["s"].to_numpy(float)
        parts = [
            late[[*keys, "trade_date"]].assign(conf=c, var=loss * tails[:, i, 0], es=loss * tails[:, i, 1])
            for i, c in enumerate(confs)
        ]
        return pd.concat(parts)

    source = rows.selectExpr(*keys, "trade_date", f"{value} AS v", f"{scale} AS s")
    kept = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)
    out = source.groupBy(*keys).applyInPandas(series, f"{kept}, trade_date date, conf double, var double, es double")
    return out.withColumn("method", F.lit(method))


def historical(returns: DataFrame, confs: Sequence[float], window: int = 500) -> DataFrame:
    """Empirical quantile of the previous ``window`` returns, and the mean beyond it."""
    rows = returns.where(F.col("r").isNotNull())
    return _rolling_estimates(rows, ["asset"], "r", confs, window, "1.0D", "historical").select(*ESTIMATE)


def _parametric(returns: DataFrame, decay: float, method: str, multipliers: dict[float, tuple[float, float]]) -> DataFrame:
    rows = returns.where(F.col("r").isNotNull())
    sigma = F.lag(F.sqrt("ewma_var")).over(by_asset())
    levels = F.array(
        *[
            F.struct(
                F.lit(c).alias("conf"), (F.col("sigma") * v).alias("var"), (F.col("sigma") * e).alias("es")
            )
            for c, (v, e) in multipliers.items()
        ]
    )
    return (
        ewma_variance(rows, decay)
        .withColumn("sigma", sigma)
        .where(F.col("sigma").isNotNull())
        .select("asset", "trade_date", F.lit(method).alias("method"), F.inline(levels))
        .select(*ESTIMATE)
    )


def normal_ewma(returns: DataFrame, confs: Sequence[float], decay: float = 0.94) -> DataFrame:
    return _parametric(returns, decay, "normal_ewma", {c: normal_multipliers(c) for c in confs})


def student_t_ewma(returns: DataFrame, confs: Sequence[float], decay: float = 0.94, df: float = 5) -> DataFrame:
    """Student-t shocks scaled to unit variance, with fixed degrees of freedom."""
    return _parametric(returns, decay, "student_t_ewma", {c: student_multipliers(c, df) for c in confs})


def fit_years(returns: DataFrame, min_obs: int = 500) -> DataFrame:
    """(asset, fit_year): the years before which an asset has at least ``min_obs`` returns."""
    rows = returns.where(F.col("r").isNotNull())
    counts = rows.groupBy("asset", F.year("trade_date").alias("fit_year")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("asset").orderBy("fit_year").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", before).where(F.col("before") >= min_obs).select("asset", "fit_year")


def yearly_fits(returns: DataFrame, min_obs: int = 500) -> DataFrame:
    """Parameters per (asset, year), each fitted on the returns strictly before that year."""
    rows = returns.where(F.col("r").isNotNull())
    years = fit_years(rows, min_obs)
    history = return_arrays(rows.withColumn("y", F.year("trade_date")), ("asset", "y"))
    # Years are joined, not days: each pair carries one year's array.
    pieces = (
        years.join(history, "asset")
        .where(F.col("y") < F.col("fit_year"))
        .groupBy("asset", "fit_year")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("y", "rets"))), lambda p: p["rets"])).alias("rets"))
    )
    # Fits differ in length and cost far more than moving their arrays, so they are spread evenly.
    return settled(fit_gjr(pieces.repartition("asset", "fit_year"))).drop("rets")


def filtered_historical(
    returns: DataFrame, fits: DataFrame, confs: Sequence[float], window: int = 500
) -> DataFrame:
    """Filtered historical simulation: sqrt(h) times the quantile of the last standardised residuals.

    Each fit year reruns the recursion over the history up to its own year end, so a row meets the
    fits of its own and later years. Of that path only the fit year and the ``window`` rows before
    it go on to the tail step.
    """
    rows = returns.where(F.col("r").isNotNull()).select("asset", "trade_date", (F.col("r") * 100).alias("x"))
    runs = rows.join(fits, "asset").where(F.year("trade_date") <= F.col("fit_year"))
    path = variance_path(runs, ("asset", "fit_year")).withColumn("z", F.col("x") / F.sqrt("h"))
    own = F.sum((F.year("trade_date") == F.col("fit_year")).cast("int"))
    back = Window.partitionBy("asset", "fit_year").orderBy("trade_date").rowsBetween(0, window)
    path = path.withColumn("_own", own.over(back)).where("_own > 0").drop("_own")
    estimates = _rolling_estimates(
        path, ["asset", "fit_year"], "z", confs, window, "sqrt(h) / 100", "fhs_gjr_garch"
    )
    return estimates.where(F.year("trade_date") == F.col("fit_year")).select(*ESTIMATE)


def all_estimates(returns: DataFrame, fits: DataFrame, s: RiskSettings = RiskSettings()) -> DataFrame:
    """Every method and confidence in one long table; ``fits`` as for ``filtered_historical``."""
    return (
        historical(returns, s.confidences, s.window)
        .unionByName(normal_ewma(returns, s.confidences, s.ewma_lambda))
        .unionByName(student_t_ewma(returns, s.confidences, s.ewma_lambda, s.student_t_df))
        .unionByName(filtered_historical(returns, fits, s.confidences, s.window))
    )


# ---- simulation ----------------------------------------------------------------------------------


def simulation_state(returns: DataFrame, params: DataFrame, window: int = 500) -> DataFrame:
    """Per asset: parameters, next-day variance and the last ``window`` standardised residuals."""
    rows = returns.where(F.col("r").isNotNull()).select("asset", "trade_date", (F.col("r") * 100).alias("x"))
    path = variance_path(rows.join(params, "asset"))
    back = Window.partitionBy("asset").orderBy(F.desc("trade_date"))
    last = path.withColumn("back", F.row_number().over(back)).where(F.col("back") <= window)
    tail = F.sort_array(F.collect_list(F.struct("trade_date", (F.col("x") / F.sqrt("h")).alias("z"))))
    return (
        last.groupBy("asset", "omega", "alpha", "gamma", "beta")
        .agg(tail.alias("_t"), F.max(F.when(F.col("back") == 1, next_variance())).alias("h_next"))
        .withColumn("resid", F.transform("_t", lambda p: p["z"]))
        .drop("_t")
    )


def simulate(row, ids: np.ndarray, horizon: int, seed: int) -> np.ndarray:
    """Cumulative decimal return of each path.

    Drawn residuals form a matrix (day, path). A shock is the residual times the day's deviation, so
    the matrix alone gives the factor by which each day's variance grows into the next.
    """
    state = [mixed(seed, ids)]
    for _ in range(horizon - 1):
        state.append(advance(state[-1]))
    z = np.asarray(row.resid, float)[scaled(np.stack(state), len(row.resid))]
    growth = row.beta + (row.alpha + row.gamma * (z < 0)) * np.square(z)
    variance = np.full_like(z, row.h_next)
    for day in range(1, horizon):
        variance[day] = row.omega + growth[day - 1] * variance[day - 1]
    return np.einsum("dp,dp->p", np.sqrt(variance), z) / 100


def monte_carlo(
    state: DataFrame, confs: Sequence[float], horizon: int = 10, paths: int = 100_000, seed: int = 0, chunks: int = 16
) -> DataFrame:
    """Horizon VaR/ES of the cumulative return by simulating variance paths with drawn residuals.

    Paths are spread as rows, one per (series, chunk of paths). A path's stream of draws starts from
    (seed, path), so a rerun task repeats its paths.
    """
    per = -(-paths // chunks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = np.arange(row.chunk * per, min((row.chunk + 1) * per, paths))
                yield pd.DataFrame({"asset": row.asset, "total": simulate(row, ids, horizon, seed)})

    spread = state.selectExpr("*", f"explode(sequence(0, {chunks - 1})) AS chunk").repartition("asset", "chunk")
    totals = spread.mapInPandas(run, "asset string, total double")
    qs = ", ".join(f"{1 - c}D" for c in confs)
    cuts = totals.groupBy("asset").agg(
        F.expr(f"percentile(total, array({qs})) AS cuts"), F.expr("collect_list(total) AS totals")
    )
    # A series has exactly the configured number of paths, so its totals fit one row.
    levels = ", ".join(f"struct({c}D AS conf, cuts[{i}] AS cut)" for i, c in enumerate(confs))
    return (
        cuts.selectExpr("asset", "totals", f"inline(array({levels}))")
        .selectExpr("asset", "conf", "cut", "filter(totals, x -> x <= cut) AS tail")
        .selectExpr("asset", "conf", "-cut AS var", "-aggregate(tail, 0.0D, (s, x) -> s + x) / size(tail) AS es")
    )


# ---- backtests -----------------------------------------------------------------------------------


def xlogy(x: Column, y: Column) -> Column:
    """x * ln(y) with 0 * ln(0) = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def kupiec_lr(x: Column, n: Column, p: Column) -> Column:
    hit = x / n
    lr = -2 * (xlogy(n - x, 1 - p) + xlogy(x, p) - xlogy(n - x, 1 - hit) - xlogy(x, hit))
    return F.greatest(lr, F.lit(0.0))


def christoffersen_lr(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    one = F.lit(1)
    pi = (n01 + n11) / F.greatest(n00 + n01 + n10 + n11, one)
    p01 = n01 / F.greatest(n00 + n01, one)
    p11 = n11 / F.greatest(n10 + n11, one)
    null = xlogy(n00 + n10, 1 - pi) + xlogy(n01 + n11, pi)
    alt = xlogy(n00, 1 - p01) + xlogy(n01, p01) + xlogy(n10, 1 - p11) + xlogy(n11, p11)
    return F.greatest(-2 * (null - alt), F.lit(0.0))


KEYS = ("asset", "method", "conf")


def exceptions(returns: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates with the day's return and exc = 1 when the loss exceeded VaR."""
    rows = estimates.where(F.col("var").isNotNull()).join(
        returns.where(F.col("r").isNotNull()), ["asset", "trade_date"]
    )
    return rows.withColumn("exc", (F.col("r") < -F.col("var")).cast("int"))


def transition_counts(exc: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("trade_date")
    prev = exc.withColumn("prev", F.lag("exc").over(w))

    def n(a: int, b: int) -> Column:
        return F.count_if((F.col("prev") == a) & (F.col("exc") == b)).alias(f"n{a}{b}")

    return prev.groupBy(*keys).agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))


def basel_shares(exc: DataFrame, keys: Sequence[str] = KEYS, window: int = 250) -> DataFrame:
    """Share of full trailing windows in each traffic-light zone."""
    w = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(-(window - 1), 0)
    counts = exc.select(*keys, F.sum("exc").over(w).alias("hits"), F.count("exc").over(w).alias("rows"))
    # At most 4 exceptions in 250 days are green, 5 to 9 yellow, more are red.
    zone = F.when(F.col("hits") <= 4, "green").when(F.col("hits") <= 9, "yellow").otherwise("red")
    full = counts.where(F.col("rows") == window).withColumn("zone", zone)
    share = [F.avg((F.col("zone") == z).cast("double")).alias(f"basel_{z}") for z in ("green", "yellow", "red")]
    return full.groupBy(*keys).agg(*share)


def backtest_table(exc: DataFrame) -> DataFrame:
    """Coverage, independence, ES ratio and Basel shares per (asset, method, confidence)."""
    keys = list(KEYS)
    hit = F.col("exc") == 1
    base = exc.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("exc").alias("exceptions"),
        F.avg("var").alias("avg_var"),
        ratio(F.avg(F.when(hit, -F.col("r"))), F.avg(F.when(hit, F.col("es")))).alias("es_ratio"),
    )
    p = 1 - F.col("conf")
    joined = base.join(transition_counts(exc), keys).join(
        basel_shares(exc.where(F.abs(F.col("conf") - 0.99) < 1e-9)), keys, "left"
    )
    lrs = joined.withColumns(
        {
            "kupiec_lr": kupiec_lr(F.col("exceptions"), F.col("n"), p),
            "indep_lr": christoffersen_lr(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11")),
        }
    )
    return lrs.select(
        *keys,
        "n",
        F.round(F.col("n") * p, 1).alias("expected"),
        "exceptions",
        (F.col("exceptions") / F.col("n")).alias("rate"),
        "kupiec_lr",
        chi2_sf(F.col("kupiec_lr"), 1).alias("kupiec_p"),
        "indep_lr",
        chi2_sf(F.col("indep_lr"), 1).alias("indep_p"),
        (F.col("kupiec_lr") + F.col("indep_lr")).alias("cc_lr"),
        chi2_sf(F.col("kupiec_lr") + F.col("indep_lr"), 2).alias("cc_p"),
        "es_ratio",
        "avg_var",
        "basel_green",
        "basel_yellow",
        "basel_red",
    )


# ---- portfolio and stress ------------------------------------------------------------------------


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "asset string, w double")


def portfolio_returns(returns: DataFrame, weights: dict[str, float], name: str = "portfolio") -> DataFrame:
    """Daily rebalanced portfolio return; a day with any asset missing has none.

    Weights are part of the query, so they enter as a literal map: no join.
    """
    w = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    held = returns.where(F.col("asset").isin(*weights) & F.col("r").isNotNull())
    return (
        held.groupBy("trade_date")
        .agg(F.sum(F.element_at(w, F.col("asset")) * F.col("r")).alias("r"), F.count("*").alias("k"))
        .where(F.col("k") == len(weights))
        .select(F.lit(name).alias("asset"), "trade_date", "r")
    )


def complete_days(returns: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Wide returns (one column per listed asset) of the days on which every one is present."""
    return (
        returns.where(F.col("asset").isin(*assets))
        .groupBy("trade_date")
        .agg(*[F.max(F.when(F.col("asset") == a, F.col("r"))).alias(a) for a in assets])
        .dropna(subset=list(assets))
    )


def betas(returns: DataFrame, assets: Sequence[str], market: str) -> DataFrame:
    """cov(asset, market) / var(market) on days complete across all listed assets and the market."""
    names = list(dict.fromkeys([*assets, market]))
    wide = complete_days(returns, names)
    agg = wide.agg(*[ratio(F.covar_samp(a, market), F.var_samp(market)).alias(a) for a in assets])
    return agg.unpivot([], list(assets), "asset", "beta")


def covariance_blocks(returns: DataFrame, assets: DataFrame, block: int = 64) -> DataFrame:
    """(asset_i, asset_j, cov) of every pair of ``assets`` (unique), in long form and for any number of them.

    Counted are the days on which every asset has a return. Assets are dealt into blocks of about
    ``block``; a task holds two blocks over all complete days (calendar-bounded) and emits the cells of
    one block pair. Nothing but the number of assets reaches the driver. One complete day has null cells.
    """
    total = assets.count()
    blocks = max(1, -(-total // block))
    rows = returns.where(F.col("r").isNotNull()).join(assets.select("asset"), "asset", "left_semi")
    full = rows.groupBy("trade_date").agg(F.count("*").alias("k")).where(F.col("k") == total).select("trade_date")
    dealt = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int")
    days = rows.join(full, "trade_date").select("trade_date", "asset", "r", dealt.alias("blk"))
    vectors = days.groupBy("trade_date", "blk").agg(F.sort_array(F.collect_list(F.struct("asset", "r"))).alias("v"))
    # A block meets every block once: under the pair's smaller number first.
    paired = vectors.select(
        "trade_date", "blk", F.col("v.asset").alias("names"), F.col("v.r").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    ).withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")})

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        sides = [pdf[pdf.blk == b] for b in (pdf.lo.iat[0], pdf.hi.iat[0])]
        if sides[0].empty or sides[1].empty:
            return pd.DataFrame({"asset_i": [], "asset_j": [], "cov": []})
        names = [np.asarray(s.names.iat[0], dtype=object) for s in sides]
        left, right = (np.stack(s.x.to_numpy()) for s in sides)
        n = len(left)
        cov = (left - left.mean(0)).T @ (right - right.mean(0)) / (n - 1) if n > 1 else np.full((left.shape[1], right.shape[1]), np.nan)
        i, j = np.repeat(names[0], len(names[1])), np.tile(names[1], len(names[0]))
        out = pd.DataFrame({"asset_i": i, "asset_j": j, "cov": cov.ravel()})
        if pdf.lo.iat[0] != pdf.hi.iat[0]:
            out = pd.concat([out, pd.DataFrame({"asset_i": j, "asset_j": i, "cov": cov.ravel()})])
        return out

    out = paired.groupBy("lo", "hi").applyInPandas(cells, "asset_i string, asset_j string, cov double")
    return out.withColumn("cov", F.nanvl("cov", F.lit(None).cast("double")))


def covariance_matrix(returns: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(asset_i, asset_j, cov) of a declared asset list: one aggregate row over complete days."""
    wide = complete_days(returns, assets)
    cells = [(a, b) for i, a in enumerate(assets) for b in assets[i:]]
    one = wide.agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    both = F.array(
        *[
            F.struct(F.lit(x).alias("asset_i"), F.lit(y).alias("asset_j"), F.col(f"c{i}").alias("cov"))
            for i, (a, b) in enumerate(cells)
            for x, y in ({(a, b), (b, a)})
        ]
    )
    return one.select(F.inline(both))


def equity_shock(beta: DataFrame, weights: dict[str, float], shock: float) -> DataFrame:
    w = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    held = beta.where(F.col("asset").isin(*weights))
    return held.agg(F.sum(F.element_at(w, F.col("asset")) * F.col("beta") * shock).alias("loss"))


def joint_shock(positions: DataFrame, shocks: dict[str, dict[str, float]]) -> DataFrame:
    """(scenario, loss) for positions (asset, w) under declared moves; unlisted assets do not move."""
    scenarios = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.create_map(*[F.lit(x) for item in moves.items() for x in item]).alias("moves"),
            )
            for name, moves in shocks.items()
        ]
    )
    rows = positions.select("asset", "w", F.inline(scenarios))
    move = F.coalesce(F.try_element_at("moves", F.col("asset")), F.lit(0.0))
    return rows.groupBy("scenario").agg(F.sum(F.col("w") * move).alias("loss"))


def stressed_normal(
    returns: DataFrame, weights: dict[str, float], conf: float, vol_multiplier: float = 1.0, blend: float = 0.0
) -> DataFrame:
    """Gaussian VaR/ES after scaling volatilities and moving correlations toward one.

    Blending every correlation toward one splits the variance into (1 - b) times the portfolio's own
    variance and b times the squared weighted sum of volatilities, so no matrix is formed.
    """
    z, tail = normal_multipliers(conf)
    wide = complete_days(returns, list(weights))
    port = sum((F.col(a) * w for a, w in list(weights.items())[1:]), F.col(next(iter(weights))) * next(iter(weights.values())))
    agg = wide.withColumn("_p", port).agg(
        F.var_samp("_p").alias("v"), *[F.stddev_samp(a).alias(f"sd_{a}") for a in weights]
    )
    together = sum((F.col(f"sd_{a}") * w for a, w in weights.items()), F.lit(0.0))
    sigma = vol_multiplier * F.sqrt((1 - blend) * F.col("v") + blend * F.pow(together, 2))
    return agg.select(sigma.alias("sigma")).select(
        "sigma", (F.col("sigma") * z).alias("var"), (F.col("sigma") * tail).alias("es")
    )


def with_drawdown(rows: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    """Adds ``dd``: wealth over its running peak minus one, with starting wealth one.

    Keys name one return series each; a series is bounded by the calendar.
    """
    upto = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = rows.withColumn("_w", F.product(F.lit(1.0) + F.col(r)).over(upto))
    return wealth.withColumn("dd", F.col("_w") / F.greatest(F.max("_w").over(upto), F.lit(1.0)) - 1).drop("_w")


def max_drawdown() -> Column:
    return F.least(F.min("dd"), F.lit(0.0)).alias("max_drawdown")


def replay(returns: DataFrame, windows: Sequence[DateWindow]) -> DataFrame:
    """Compounded return, drawdown and worst day of each series in each historical window."""
    rows = in_windows(returns.where(F.col("r").isNotNull()), windows, "trade_date", "scenario")
    return (
        with_drawdown(rows, ["asset", "scenario"])
        .groupBy("scenario", "asset")
        .agg(
            F.count("*").alias("days"),
            compounded(F.col("r")).alias("total_return"),
            max_drawdown(),
            F.min("r").alias("worst_day"),
        )
    )


def tail_means(rows: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Per series: quantile and mean of the values at or below it, for each named level."""
    cuts = rows.groupBy(*keys).agg(*[F.percentile(value, q).alias(f"q_{n}") for n, q in qs.items()])
    below = [F.avg(F.when(F.col(value) <= F.col(f"q_{n}"), F.col(value))).alias(f"m_{n}") for n in qs]
    means = rows.join(cuts, list(keys)).groupBy(*keys).agg(*below)
    return cuts.join(means, list(keys))


def portfolio_metrics(
    portfolio: DataFrame, market: DataFrame, cash: DataFrame, confs: Sequence[float] = (0.95, 0.99), days: int = 252
) -> DataFrame:
    """Return, volatility, Sharpe, drawdown, beta, correlation, historical VaR/ES per portfolio.

    ``market`` is (trade_date, m) and ``cash`` (trade_date, cash), both one row per day at most.
    """
    rows = (
        portfolio.where(F.col("r").isNotNull())
        .join(F.broadcast(market), "trade_date")
        .join(F.broadcast(cash), "trade_date")
        .dropna(subset=["m", "cash"])
    )
    excess = F.col("r") - F.col("cash")
    base = (
        with_drawdown(rows, ["asset"])
        .groupBy("asset")
        .agg(
            (F.pow(F.product(1 + F.col("r")), F.lit(float(days)) / F.count("*")) - 1).alias("ann_return"),
            (F.stddev_samp("r") * days**0.5).alias("ann_vol"),
            (ratio(F.avg(excess), F.stddev_samp(excess)) * days**0.5).alias("sharpe"),
            max_drawdown(),
            ratio(F.covar_samp("r", "m"), F.var_samp("m")).alias("beta_to_market"),
            F.corr("r", "m").alias("corr_to_market"),
        )
    )
    tails = tail_means(rows, ["asset"], "r", {f"{round(c * 100)}": 1 - c for c in confs})
    names = [f"{round(c * 100)}" for c in confs]
    return base.join(tails, "asset").select(
        *base.columns,
        *[(-F.col(f"q_{n}")).alias(f"hist_var_{n}") for n in names],
        *[(-F.col(f"m_{n}")).alias(f"hist_es_{n}") for n in names],
    )
