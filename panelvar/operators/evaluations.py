"""Store of walk-forward results: model versions, predictions, metrics and trials, replaced by key.

A model is published under (purpose, label, model). Publishing replaces everything stored under the
keys that it brings and leaves all others, so a repeated run leaves one set of rows. Outcomes are not
stored: they join in from the labels when predictions are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin
from ..sources import sinks
from . import metrics

#: Partition columns of every table of the store.
KEYS = ("purpose", "label", "model")
_COMMON = "fold string, version string, purpose string, label string, model string"
#: Declared, since a table may hold no rows (models without trials).
TABLES = {
    "version": f"train_start date, train_end date, n_predictions bigint, chosen string, data_hash string, {_COMMON}",
    "prediction": f"asset string, as_of_date date, prob double, {_COMMON}",
    "metric": f"metric string, value double, n_obs bigint, {_COMMON}",
    "trial": f"grid_pos int, params string, score double, {_COMMON}",
}


def version_id(fold: Column | str = "fold") -> Column:
    """The same model, purpose, label and fold always get the same version id."""
    fold = F.col(fold) if isinstance(fold, str) else fold
    return F.sha2(F.concat_ws("|", "purpose", "label", "model", fold), 256)


def versions(preds: DataFrame, info: DataFrame, trials: DataFrame) -> DataFrame:
    """One row per (model, fold) with predictions, and one pooled row per model over all its folds.

    ``chosen`` holds the parameters of the fold's best trial; models without trials have none.
    """
    best = metrics.best_configuration(trials).select("model", "fold", F.col("params").alias("chosen"))
    used = preds.groupBy("model", "fold").agg(F.count("*").alias("n_predictions"))
    folds = used.join(info.select("fold", "train_start", "train_end"), "fold").join(best, ["model", "fold"], "left")
    span = info.agg(F.min("train_start").alias("train_start"), F.max("train_end").alias("train_end"))
    pooled = folds.groupBy("model").agg(F.sum("n_predictions").alias("n_predictions"))
    pooled = pooled.crossJoin(F.broadcast(span)).withColumns(  # ``span`` is one row
        {"fold": F.lit("pooled"), "chosen": F.lit(None).cast("string")}
    )
    return folds.unionByName(pooled)


def publish(
    root: str, preds: DataFrame, info: DataFrame, trials: DataFrame, purpose: str, label: str, data_hash: str
) -> None:
    """Replace the stored results of every model in ``preds`` and of every model in ``trials``.

    ``preds`` is (model, fold, asset, as_of_date, prob, y), ``info`` the fold table, ``trials``
    (model, fold, grid_pos, params, score). The inputs are evaluated once. Versions go last: readers
    start from them, and a publication that died before is completed by running it again.
    """
    preds = pin(preds)
    keyed = {"purpose": F.lit(purpose), "label": F.lit(label)}
    long = metrics.metrics_long(metrics.evaluate(preds)).withColumnRenamed("n", "n_obs")
    parts = {
        "prediction": preds.select("model", "fold", "asset", "as_of_date", "prob"),
        "metric": long.withColumnRenamed("scope", "fold"),
        "trial": trials.select("model", "fold", "grid_pos", "params", "score"),
        "version": versions(preds, info, trials).withColumn("data_hash", F.lit(data_hash)),
    }
    for name, part in parts.items():
        rows = part.withColumns(keyed).withColumn("version", version_id())
        sinks.replace_keys(rows, f"{root}/{name}", KEYS)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name} in the store; there are {', '.join(TABLES)}")
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def outcomes(spark: SparkSession, root: str, labels: DataFrame, purpose: str, label: str) -> DataFrame:
    """Stored predictions of one purpose and label with today's outcomes; the key filter prunes partitions."""
    wanted = (F.col("purpose") == purpose) & (F.col("label") == label)
    known = read(spark, root, "version").where(wanted).select("version")
    stored = read(spark, root, "prediction").where(wanted).join(known, "version", "left_semi")
    return stored.join(labels.where(F.col("y").isNotNull()), ["asset", "as_of_date"])


def frozen_hash(spark: SparkSession, root: str, purpose: str, label: str, data_hash: str) -> None:
    """Refuse stored versions that were fitted on other data, or none at all."""
    wanted = (F.col("purpose") == purpose) & (F.col("label") == label)
    stale = (
        read(spark, root, "version")
        .where(wanted)
        .agg(F.count("*").alias("n"), F.count_if(F.col("data_hash") != data_hash).alias("other"))
        .first()
    )
    if not stale.n:
        raise ValueError(f"nothing is stored under {purpose}, {label}")
    if stale.other:
        raise ValueError(f"{stale.other} of {stale.n} stored versions were fitted on other data")
