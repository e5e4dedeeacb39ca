"""Forecast-comparison tests: Diebold-Mariano, stationary bootstrap, Holm adjustment.

Tests run per asset and pair of models; a series is one asset's test days, bounded by the calendar.
Resampling draws are spread as rows, one per (series, chunk of draws); a task turns its draws into day
counts with array arithmetic, so nothing is shuffled per resampled day and every draw is repeatable.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from ..functions.tails import t_two_sided
from ..functions.uniform import MODULUS, mixed, scaled
from ..settings import TRADING_DAYS, InferenceSettings
from .metrics import log_loss

# Declared comparisons, each learner against the two benchmarks and the variance model.
LEARNERS = ("logit_tuned", "hist_gb", "random_forest")
BENCHMARKS = ("har_logit", "vix_logit")
PAIRS = tuple(("benchmark", a, b) for a in LEARNERS for b in BENCHMARKS) + tuple(
    ("garch", a, "garch_logit") for a in LEARNERS
)


def _pair_array(pairs: Sequence[tuple[str, str, str]]) -> Column:
    return F.array(
        *[F.struct(F.lit(f).alias("family"), F.lit(a).alias("model"), F.lit(b).alias("vs")) for f, a, b in pairs]
    )


def by_model(preds: DataFrame) -> DataFrame:
    """One row per (asset, fold, date) with the model probabilities as a short sorted list."""
    return preds.groupBy("asset", "fold", "as_of_date").agg(
        F.max("y").alias("y"), F.sort_array(F.collect_list(F.struct("model", "prob"))).alias("probs")
    )


def paired_predictions(preds: DataFrame, pairs: Sequence[tuple[str, str, str]] = PAIRS) -> DataFrame:
    """Common (asset, fold, date) rows of each declared pair: p_a and p_b next to the outcome.

    The models of one day share a row, so all pairs come from one shuffle and no self-join.
    """
    rows = by_model(preds).select("asset", "fold", "as_of_date", "y", "probs", F.inline(_pair_array(pairs)))
    by_name = F.map_from_entries("probs")
    p_a, p_b = F.try_element_at(by_name, F.col("model")), F.try_element_at(by_name, F.col("vs"))
    return rows.select(
        "family", "model", "vs", "asset", "fold", "as_of_date", "y", p_a.alias("p_a"), p_b.alias("p_b")
    ).where(F.col("p_a").isNotNull() & F.col("p_b").isNotNull())


def dm_test(diffs: DataFrame, keys: Sequence[str], order: Sequence[str], horizon: int = 5) -> DataFrame:
    """Equal expected loss from the series of differences ``d``: mean, statistic and p-value.

    Bartlett long-run variance up to lag horizon - 1 with the small-sample correction. A variance
    that is not positive gives p = 1 for a zero mean and no p-value otherwise.
    """
    keys = list(keys)
    series = Window.partitionBy(*keys).orderBy(*order)
    centred = diffs.withColumn("c", F.col("d") - F.avg("d").over(Window.partitionBy(*keys)))
    lags = range(1, horizon)
    shifted = centred.withColumns({f"c{k}": F.lag("c", k).over(series) for k in lags})
    agg = shifted.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("d").alias("mean_diff"),
        F.sum(F.col("c") * F.col("c")).alias("s0"),
        *[F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"s{k}") for k in lags],
    )
    n = F.col("n")
    v = sum((2 * (1 - k / horizon) * F.col(f"s{k}") for k in lags), F.col("s0")) / n
    small = F.sqrt(F.greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n, F.lit(0.0)))
    stat = F.when(v > 0, F.col("mean_diff") / F.sqrt(v / n) * small)
    out = agg.withColumn("v", v).withColumn("stat", stat)
    p = F.when(F.col("v") > 0, t_two_sided(F.col("stat"), n - 1)).when(F.col("mean_diff") == 0, F.lit(1.0))
    return out.select(*keys, "n", "mean_diff", "stat", p.alias("p_dm"))


def loss_differences(paired: DataFrame) -> DataFrame:
    return paired.withColumn("d", log_loss(F.col("y"), F.col("p_a")) - log_loss(F.col("y"), F.col("p_b")))


def holm(tests: DataFrame, family: Sequence[str], p: str, out: str) -> DataFrame:
    """Step-down adjustment within each family of comparisons (a declared, short list)."""
    ordered = Window.partitionBy(*family).orderBy(p, "model", "vs")
    m = F.count("*").over(Window.partitionBy(*family))
    step = (m - F.row_number().over(ordered) + 1) * F.col(p)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_step", step).withColumn(out, F.least(F.max("_step").over(upto), F.lit(1.0))).drop("_step")


# ---- stationary bootstrap ------------------------------------------------------------------------


def resample(draws: np.ndarray, n: int, seed: int, mean_block: int) -> np.ndarray:
    """(draws, n) source positions of the stationary bootstrap.

    Each draw is a row of blocks laid end to end: block k has a geometric length with the given
    mean, by inversion of a uniform number, and a uniform source position; sources wrap at n.
    """
    d, k = np.asarray(draws, np.int64)[:, None], np.arange(n)
    u = (mixed(seed, d, 0, k) + 0.5) / MODULUS
    length = np.clip(np.ceil(np.log(u) / np.log1p(-1.0 / mean_block)), 1, n).astype(np.int64)
    ends = np.cumsum(length, axis=1)
    shift = scaled(mixed(seed, d, 1, k), n) - (ends - length)
    out = np.empty((len(ends), n), np.int64)
    for row, (s, size) in enumerate(zip(shift, length)):
        out[row] = np.repeat(s, size)[:n]
    return (out + k) % n


def resample_counts(draws: np.ndarray, n: int, seed: int, mean_block: int) -> np.ndarray:
    """(draws, n): how often each position is drawn."""
    index = resample(draws, n, seed, mean_block) + np.arange(len(draws))[:, None] * n
    return np.bincount(index.ravel(), minlength=len(draws) * n).reshape(len(draws), n)


def _spread(packed: DataFrame, draws: int, chunks: int, keys: Sequence[str]) -> DataFrame:
    """One row per (series, chunk of draws), shuffled so that chunks run in parallel."""
    per = -(-draws // chunks)
    return packed.selectExpr(
        "*", f"explode(transform(sequence(0, {chunks - 1}), c -> struct(c * {per} AS first, least((c + 1) * {per}, {draws}) AS last))) AS part"
    ).selectExpr(*packed.columns, "part.first", "part.last").where("first < last").repartition(*keys, "first")


def bootstrap_index(series: DataFrame, draws: int, seed: int, mean_block: int, chunks: int = 16) -> DataFrame:
    """(asset, fold, draw, pos, idx): source position of every resampled position. ``series`` has n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = np.arange(row.first, row.last)
                index = resample(ids, row.n, seed, mean_block)
                yield pd.DataFrame(
                    {
                        "asset": row.asset,
                        "fold": row.fold,
                        "draw": np.repeat(ids, row.n),
                        "pos": np.tile(np.arange(row.n), len(ids)),
                        "idx": index.ravel(),
                    }
                )

    spread = _spread(series.select("asset", "fold", "n"), draws, chunks, ["asset", "fold"])
    return spread.mapInPandas(
        run, "asset string, fold string, draw bigint, pos bigint, idx bigint"
    )


def sharpe_draws(excess: DataFrame, s: InferenceSettings = InferenceSettings(), chunks: int = 16) -> DataFrame:
    """(asset, draw, strategy, sharpe): Sharpe ratio of every strategy on the same resampled days.

    ``excess`` is (asset, trade_date, strategy, x). A draw is a vector of day counts, so its moments
    are products of counts with the returns and their squares.
    """
    daily = excess.groupBy("asset", "trade_date").agg(
        F.sort_array(F.collect_list(F.struct("strategy", "x"))).alias("e")
    )
    ordered = F.sort_array(F.collect_list(F.struct("trade_date", F.transform("e", lambda v: v["x"]).alias("x"))))
    packed = daily.groupBy("asset").agg(
        F.transform(F.first("e"), lambda v: v["strategy"]).alias("names"),
        F.transform(ordered, lambda v: v["x"]).alias("x"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.stack(list(row.x))
                n = len(x)
                ids = np.arange(row.first, row.last)
                counts = resample_counts(ids, n, s.seed, s.mean_block)
                mean = counts @ x / n
                var = (counts @ (x * x) - n * mean * mean) / (n - 1)
                sharpe = np.where(var > 0, mean / np.sqrt(np.where(var > 0, var, 1.0)), np.nan) * TRADING_DAYS**0.5
                yield pd.DataFrame(
                    {
                        "asset": row.asset,
                        "draw": np.repeat(ids, len(row.names)),
                        "strategy": np.tile(np.asarray(row.names, object), len(ids)),
                        "sharpe": sharpe.ravel(),
                    }
                )

    return _spread(packed, s.draws, chunks, ["asset"]).mapInPandas(
        run, "asset string, draw bigint, strategy string, sharpe double"
    )


def average_precision(counts: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Average precision per row of ``counts``; NaN where no positive is drawn."""
    order = np.argsort(-p, kind="stable")
    last = np.append(p[order][1:] != p[order][:-1], True)
    drawn = counts[:, order].astype(float)
    every = np.cumsum(drawn, axis=1)[:, last]
    hits = np.cumsum(drawn * y[order], axis=1)[:, last]
    gained = np.diff(hits, axis=1, prepend=0.0)
    area = (gained * hits / np.maximum(every, 1.0)).sum(axis=1)
    return np.where(hits[:, -1] > 0, area / np.maximum(hits[:, -1], 1.0), np.nan)


def pr_auc_draws(preds: DataFrame, s: InferenceSettings = InferenceSettings(), chunks: int = 16) -> DataFrame:
    """(asset, fold, draw, model, ap): average precision of every model on the same resampled days.

    Draw -1 is the observed sample. A draw only changes how often each day counts, so the score
    order of a fold is sorted once per task.
    """
    rows = by_model(preds)
    ordered = F.sort_array(F.collect_list(F.struct("as_of_date", "y", F.transform("probs", lambda e: e["prob"]).alias("p"))))
    packed = rows.groupBy("asset", "fold").agg(
        F.transform(F.first("probs"), lambda e: e["model"]).alias("names"),
        F.transform(ordered, lambda v: v["y"].cast("double")).alias("y"),
        F.transform(ordered, lambda v: v["p"]).alias("p"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                y, p = np.asarray(row.y, float), np.stack(list(row.p))
                ids = np.arange(row.first, row.last)
                counts = resample_counts(ids, len(y), s.seed, s.mean_block)
                if row.first == 0:
                    ids = np.append(-1, ids)
                    counts = np.vstack([np.ones((1, len(y)), counts.dtype), counts])
                for j, name in enumerate(row.names):
                    yield pd.DataFrame(
                        {
                            "asset": row.asset,
                            "fold": row.fold,
                            "draw": ids,
                            "model": name,
                            "ap": average_precision(counts, y, p[:, j]),
                        }
                    )

    return _spread(packed, s.draws, chunks, ["asset", "fold"]).mapInPandas(
        run, "asset string, fold string, draw bigint, model string, ap double"
    )


def _summary(diffs: DataFrame, keys: Sequence[str], n_draws: int, observed: str) -> DataFrame:
    """Observed difference (draw -1), percentile interval and two-sided p-value of the draws."""
    drawn = "CASE WHEN draw >= 0 THEN diff END"
    low, high = f"avg(cast({drawn} <= 0 AS double))", f"avg(cast({drawn} >= 0 AS double))"
    return diffs.groupBy(*keys).agg(
        F.expr(f"max(CASE WHEN draw < 0 THEN diff END) AS {observed}"),
        F.expr(f"percentile({drawn}, 0.025) AS ci_low"),
        F.expr(f"percentile({drawn}, 0.975) AS ci_high"),
        F.expr(f"least(greatest(2 * least({low}, {high}), {1.0 / (n_draws + 1)}D), 1.0D) AS p_boot"),
    )


def sharpe_tests(
    excess: DataFrame, pairs: Sequence[tuple[str, str, str]], s: InferenceSettings = InferenceSettings()
) -> DataFrame:
    """Paired Sharpe differences with interval, p-value and Holm adjustment per family and asset."""
    keys = ["asset", "family", "model", "vs"]
    listed = F.inline(_pair_array(pairs))
    a, b = F.col("model"), F.col("vs")

    def difference(m: Column) -> Column:
        return F.try_element_at(m, a) - F.try_element_at(m, b)

    observed = excess.groupBy("asset", "strategy").agg(
        (ratio(F.avg("x"), F.stddev_samp("x")) * TRADING_DAYS**0.5).alias("sharpe")
    )
    both = observed.select("asset", F.lit(-1).cast("bigint").alias("draw"), "strategy", "sharpe").unionByName(
        sharpe_draws(excess, s)
    )
    by_draw = both.where(F.col("sharpe").isNotNull() & ~F.isnan("sharpe")).groupBy("asset", "draw").agg(
        F.map_from_entries(F.collect_list(F.struct("strategy", "sharpe"))).alias("m")
    )
    diffs = by_draw.select("asset", "draw", "m", listed).select(*keys, "draw", difference(F.col("m")).alias("diff"))
    out = _summary(diffs.where(F.col("diff").isNotNull()), keys, s.draws, "sharpe_diff")
    return holm(out, ["asset", "family"], "p_boot", "p_boot_holm")


def pr_auc_tests(preds: DataFrame, pairs: Sequence[tuple[str, str, str]] = PAIRS, s: InferenceSettings = InferenceSettings()) -> DataFrame:
    """Difference in fold-mean average precision per pair, with bootstrap interval and p-value."""
    keys = ["asset", "family", "model", "vs"]
    diff = F.try_element_at("m", F.col("model")) - F.try_element_at("m", F.col("vs"))
    by_fold = (
        pr_auc_draws(preds, s)
        .where(~F.isnan("ap"))
        .groupBy("asset", "fold", "draw")
        .agg(F.map_from_entries(F.collect_list(F.struct("model", "ap"))).alias("m"))
    )
    per_draw = (
        by_fold.select("asset", "draw", "m", F.inline(_pair_array(pairs)))
        .groupBy(*keys, "draw")
        .agg(F.avg(diff).alias("diff"))
        .where(F.col("diff").isNotNull())
    )
    return _summary(per_draw, keys, s.draws, "pr_auc_diff")


def pairwise_tests(preds: DataFrame, pairs: Sequence[tuple[str, str, str]] = PAIRS, s: InferenceSettings = InferenceSettings()) -> DataFrame:
    """Bootstrap and loss tests of every declared pair, Holm-adjusted within asset and family."""
    keys = ["asset", "family", "model", "vs"]
    boot = pr_auc_tests(preds, pairs, s)
    dm = dm_test(loss_differences(paired_predictions(preds, pairs)), keys, ["fold", "as_of_date"], s.dm_horizon)
    both = boot.join(dm.withColumnRenamed("mean_diff", "logloss_diff"), keys).withColumn(
        "_p", F.coalesce("p_dm", F.lit(1.0))
    )
    adjusted = holm(holm(both, ["asset", "family"], "p_boot", "p_boot_holm"), ["asset", "family"], "_p", "p_dm_holm")
    return adjusted.drop("_p", "n", "stat")
