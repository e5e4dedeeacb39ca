"""Probability models over purged folds, as Spark ML fits.

The frame is written once; every (fold, model, configuration) fit reads it with its own time
predicate. Fits are independent jobs submitted from a small thread pool, so a small panel keeps the
cluster busy and a large one is split by Spark inside each fit. Only fold labels, split counts and
scores (a few rows each) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from itertools import product

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import clip
from ..session import pin
from ..settings import PROB_CLIP, Fold
from .boosting import Fit, boost
from .features import BASE_FEATURES, design_matrix
from .garch import average_forecast, fit_gjr, return_arrays, settled, variance_path
from .metrics import best_configuration, cv_scores, log_loss
from .splits import assign_folds, inner_splits, train_mask

KEYS = ("asset", "as_of_date")
SEED = 0


@dataclass(frozen=True)
class Spec:
    """A model: inputs, a factory from (configuration, training rows) to an estimator, and its grid."""

    name: str
    family: str
    features: tuple[str, ...]
    make: Callable[[dict, int], Estimator]
    grid: dict[str, Sequence[float]] = field(default_factory=dict)
    log_transform: bool = True

    @property
    def configurations(self) -> list[dict]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


def logit(config: dict, n_train: int) -> Estimator:
    """Standardised L2 logit with inverse penalty C on the summed loss.

    Spark averages the loss, so the penalty is divided by C and the row count; its scaler uses the
    sample deviation, which the factor (n - 1) / n turns into the population one.
    """
    n = max(n_train, 2)
    penalty = (n - 1) / (config.get("C", 1.0) * n * n)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="x")
    model = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8
    )
    return Pipeline(stages=[scaler, model])


def boosting(iterations: int) -> Callable[[dict, int], Estimator]:
    return lambda config, n: GBTClassifier(
        featuresCol="raw",
        labelCol="y",
        maxDepth=int(config["max_depth"]),
        stepSize=config["learning_rate"],
        maxIter=iterations,
        minInstancesPerNode=50,
        seed=SEED,
    )


def forest(trees: int) -> Callable[[dict, int], Estimator]:
    return lambda config, n: RandomForestClassifier(
        featuresCol="raw",
        labelCol="y",
        numTrees=trees,
        maxDepth=int(config["max_depth"]),
        minInstancesPerNode=int(config["min_leaf"]),
        featureSubsetStrategy="sqrt",
        seed=SEED,
    )


def ladder(full: Sequence[str] = BASE_FEATURES) -> list[Spec]:
    """The fixed benchmarks above the prevalence constant."""
    return [
        Spec("persistence_logit", "persistence", ("rv_5d",), logit),
        Spec("har_logit", "har", ("rv_5d", "rv_21d", "rv_63d"), logit),
        Spec("vix_logit", "vix", ("vix_level",), logit),
        Spec("logit_full", "logistic", tuple(full), logit),
    ]


def learners(full: Sequence[str] = BASE_FEATURES, iterations: int = 150, trees: int = 300) -> list[Spec]:
    """The tuned models with their declared grids."""
    full = tuple(full)
    return [
        Spec("logit_tuned", "logistic", full, logit, {"C": (0.01, 0.1, 1.0)}),
        Spec("hist_gb", "gradient_boosting", full, boosting(iterations), {"max_depth": (2, 3), "learning_rate": (0.03, 0.1)}, False),
        Spec("random_forest", "random_forest", full, forest(trees), {"max_depth": (4, 8), "min_leaf": (20, 50)}, False),
    ]


def _inputs(rows: DataFrame, spec: Spec) -> DataFrame:
    shaped = design_matrix(rows, spec.features) if spec.log_transform else rows
    return VectorAssembler(inputCols=list(spec.features), outputCol="raw").transform(shaped)


def _fit_score(train: DataFrame, test: DataFrame, spec: Spec, config: dict, n_train: int) -> DataFrame:
    model = spec.make(config, n_train).fit(_inputs(train, spec).select("raw", "y"))
    scored = model.transform(_inputs(test, spec))
    return scored.select(*KEYS, "y", vector_to_array("probability")[1].alias("prob"))


def tuning_scores(rows: DataFrame, spec: Spec, folds: Sequence[Fold], n_years: int = 3, min_rows: int = 500, threads: int = 8) -> DataFrame:
    """(model, fold, grid_pos, params, score): mean inner log loss of every configuration tried."""
    train = assign_folds(rows, folds).where(F.col("role") == "train")
    splits = inner_splits(train, n_years, min_rows).collect()
    starts = {f.label: f.test_start for f in folds}

    def one(job) -> tuple:
        split, (pos, config) = job
        opens = F.make_date(F.lit(split.year), F.lit(1), F.lit(1))
        outer = rows.where(train_mask(F.lit(starts[split.fold])))
        scored = _fit_score(
            outer.where(train_mask(opens)), outer.where(F.year("as_of_date") == split.year), spec, config, split.n_train
        )
        p = clip(F.col("prob"), PROB_CLIP, 1 - PROB_CLIP)
        loss = scored.agg(F.avg(log_loss(F.col("y"), p))).first()[0]
        return (spec.name, split.fold, pos, str(config), split.year, loss)

    jobs = list(product(splits, enumerate(spec.configurations)))
    if not jobs:
        raise ValueError("no valid inner split: the training window is too short to tune")
    with ThreadPoolExecutor(threads) as pool:
        losses = list(pool.map(one, jobs))
    table = rows.sparkSession.createDataFrame(
        losses, "model string, fold string, grid_pos int, params string, year int, loss double"
    )
    return table.groupBy("model", "fold", "grid_pos", "params").agg(F.avg("loss").alias("score"), F.count("*").alias("splits"))


def walk_forward(rows: DataFrame, specs: Sequence[Spec], folds: Sequence[Fold], threads: int = 8) -> tuple[DataFrame, DataFrame | None]:
    """(predictions, trials) of every model on every fold; all models see the same rows.

    ``rows`` are eligible rows, pinned by the caller. Predictions are pinned, because a fitted model
    is not part of a plan that a later reader could recompute.
    """
    trials = [tuning_scores(rows, s, folds, threads=threads) for s in specs if s.grid]
    chosen = {}
    for table in trials:
        for best in best_configuration(table).collect():
            chosen[best.model, best.fold] = best.grid_pos
    sizes = {
        r.fold: r
        for r in assign_folds(rows, folds).groupBy("fold").agg(
            F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
        ).collect()
    }

    def one(job) -> DataFrame:
        fold, spec = job
        config = spec.configurations[chosen.get((spec.name, fold.label), 0)]
        day = F.col("as_of_date")
        train = rows.where(train_mask(F.lit(fold.test_start)))
        test = rows.where((day >= F.lit(fold.test_start)) & (day <= F.lit(fold.test_end)))
        scored = _fit_score(train, test, spec, config, sizes[fold.label].n_train)
        return scored.select(F.lit(spec.name).alias("model"), F.lit(fold.label).alias("fold"), *KEYS, "prob", "y")

    usable = [f for f in folds if f.label in sizes and sizes[f.label].n_train and sizes[f.label].n_test]
    with ThreadPoolExecutor(threads) as pool:
        # A tuned model has no rows in a fold without a valid inner year.
        parts = list(pool.map(one, [(f, s) for f, s in product(usable, specs) if not s.grid or (s.name, f.label) in chosen]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    all_trials = None
    for table in trials:
        all_trials = table if all_trials is None else all_trials.unionByName(table)
    return pin(out), all_trials


def boosted_walk_forward(
    rows: DataFrame, folds: Sequence[Fold], features: Sequence[str] = BASE_FEATURES, iterations: int = 150, n_years: int = 3, min_rows: int = 500
) -> tuple[DataFrame, DataFrame]:
    """(predictions, trials) of boosting, tuned by inner years; a fold without a valid inner year has no rows in either.

    A window is the rows whose labels were known before a day, so an inner window and the training
    window of the fold that starts on the same day are one: every (window, setting) is fitted once.
    """
    spec = next(s for s in learners(features) if s.name == "hist_gb")
    settings = spec.configurations
    train = assign_folds(rows, folds).where(F.col("role") == "train")
    inner = pin(inner_splits(train, n_years, min_rows))
    starts = {f.label: f.test_start for f in folds}
    years = [r.year for r in inner.select("year").distinct().collect()]
    cutoffs = sorted({date(y, 1, 1) for y in years} | {starts[r.fold] for r in inner.select("fold").distinct().collect()})
    keys = list(KEYS)
    fits = [Fit(c, int(x["max_depth"]), x["learning_rate"]) for c in cutoffs for x in settings]
    if not fits:
        empty = rows.where("false")
        trials = inner.selectExpr("'' AS model", "fold", "0 AS grid_pos", "'' AS params", "0.0D AS score", "0L AS splits").where("false")
        return empty.selectExpr("'hist_gb' AS model", "'' AS fold", *keys, "0.0D AS prob", "y"), trials
    scored = boost(rows, features, fits, keys, iterations)
    table = [(k, f.cutoff, k % len(settings), str(settings[k % len(settings)])) for k, f in enumerate(fits)]
    named = rows.sparkSession.createDataFrame(table, "fit int, cutoff date, grid_pos int, params string")
    scored = scored.join(F.broadcast(named), "fit")  # a row per fit
    listed = F.array(*[F.struct(F.lit(f.label).alias("fold"), F.lit(f.test_start).alias("opens"), F.lit(f.test_end).alias("closes")) for f in folds])
    each = scored.withColumn("f", F.explode(listed)).select(F.lit(spec.name).alias("model"), "f.*", *[c for c in scored.columns])
    p = clip(F.col("prob"), PROB_CLIP, 1 - PROB_CLIP)
    opens = F.datediff("opens", F.lit(date(1970, 1, 1)))
    held = each.where((F.year("as_of_date") == F.year("cutoff")) & (F.dayofyear("cutoff") == 1) & (F.col("known") < opens)).withColumn("year", F.year("cutoff"))
    losses = held.join(F.broadcast(inner.select("fold", "year")), ["fold", "year"])  # a row per fold and year
    losses = losses.groupBy("model", "fold", "grid_pos", "params", "year").agg(F.avg(log_loss(F.col("y"), p)).alias("loss"))
    trials = pin(cv_scores(losses))
    best = best_configuration(trials).select("fold", "grid_pos")
    tested = each.where((F.col("cutoff") == F.col("opens")) & F.col("as_of_date").between(F.col("opens"), F.col("closes")))
    return pin(tested.join(F.broadcast(best), ["fold", "grid_pos"]).select("model", "fold", *keys, "prob", "y")), trials


def variance_scores(rows: DataFrame, returns: DataFrame, folds: Sequence[Fold], horizon: int = 5) -> DataFrame:
    """(fold, asset, as_of_date, garch_vol): forecast volatility from parameters of each training window.

    Parameters use returns through the fold's last training day; the recursion then runs over the
    whole series, so a forecast uses returns up to its own day. The recursion starts from the sample
    variance, the fit from the population variance.
    """
    train = assign_folds(rows, folds).where(F.col("role") == "train")
    ends = train.groupBy("fold").agg(F.max("as_of_date").alias("train_end"))
    # The declared folds are one short list, exploded in place.
    listed = ends.select(F.collect_list(F.struct("fold", "train_end"))).scalar()
    history = (
        returns.where(F.col("r").isNotNull())
        .withColumn("ends", listed)
        .select("asset", "trade_date", "r", F.inline("ends"))
    )
    arrays = return_arrays(history.where(F.col("trade_date") <= F.col("train_end")), ("asset", "fold"))
    fits = settled(fit_gjr(arrays.repartition("asset", "fold"))).withColumn("h0", F.expr("h0 * size(rets) / (size(rets) - 1)")).drop("rets", "nll")
    path = variance_path(
        history.selectExpr("asset", "fold", "trade_date", "r * 100 AS x").join(pin(fits), ["asset", "fold"]), ("asset", "fold")
    )
    vol = F.sqrt(252 * average_forecast(horizon) / 1e4)
    return path.select("fold", "asset", F.col("trade_date").alias("as_of_date"), vol.alias("garch_vol"))


def variance_logit(rows: DataFrame, returns: DataFrame, folds: Sequence[Fold], horizon: int = 5, threads: int = 8) -> DataFrame:
    """Logistic calibration of the log forecast volatility, per fold."""
    scores = pin(variance_scores(rows, returns, folds, horizon).withColumn("garch_vol", F.log("garch_vol")))
    spec = Spec("garch_logit", "garch", ("garch_vol",), logit)

    def one(fold: Fold) -> DataFrame:
        joined = rows.join(scores.where(F.col("fold") == fold.label).drop("fold"), list(KEYS))
        return walk_forward(joined, [spec], [fold], threads=1)[0]

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
