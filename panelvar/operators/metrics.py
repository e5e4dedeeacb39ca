"""Ranking, probability and calibration metrics per (model, scope).

A scope is a fold or ``pooled``, and the pooled scope holds every row. So nothing here sorts a scope
in one task: rows reduce to counts per distinct score, and ordered sums run in score buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import clip
from ..functions.ordered import exact_quantiles, running_totals
from ..session import pin
from ..settings import PROB_CLIP

KEYS = ("model", "scope")


def log_loss(y: Column, p: Column) -> Column:
    c = clip(p, PROB_CLIP, 1 - PROB_CLIP)
    return -(y * F.log(c) + (1 - y) * F.log(1 - c))


def score_counts(preds: DataFrame) -> DataFrame:
    """(model, scope, prob, pos, neg): outcomes per distinct score, per fold and pooled.

    Every metric is a function of this table. Folds are counted first and the pooled scope is added
    from the counts; the result is pinned, because all metrics read it.
    """
    folds = preds.groupBy("model", "fold", "prob").agg(
        F.expr("sum(cast(y AS bigint)) AS pos"), F.expr("sum(1 - cast(y AS bigint)) AS neg")
    )
    scopes = folds.selectExpr("model", "prob", "pos", "neg", "explode(array(fold, 'pooled')) AS scope")
    return pin(
        scopes.groupBy("model", "scope", "prob").agg(F.expr("sum(pos) AS pos"), F.expr("sum(neg) AS neg"))
    )


def probability_metrics(counts: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    p = f"greatest(least(prob, {1 - PROB_CLIP}D), {PROB_CLIP}D)"
    return counts.groupBy(*by).agg(
        F.expr("sum(pos + neg) AS n"),
        F.expr("sum(pos) / sum(pos + neg) AS prevalence"),
        F.expr("sum(pos * pow(prob - 1, 2) + neg * pow(prob, 2)) / sum(pos + neg) AS brier"),
        F.expr(f"-sum(pos * ln({p}) + neg * ln(1 - {p})) / sum(pos + neg) AS log_loss"),
    )


def ranking_metrics(counts: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; NULL where only one class occurs.

    Going down the scores, a negative is beaten by the positives above it and half of its ties.
    """
    ranked = running_totals(counts, by, "prob", ["pos", "neg"], descending=True)
    totals = ranked.groupBy(*by).agg(
        F.expr("sum(pos) AS P"),
        F.expr("sum(neg) AS N"),
        F.expr("sum(neg * (cum_pos - pos) + neg * pos / 2) AS won"),
        F.expr("sum(pos * cum_pos / (cum_pos + cum_neg)) AS ap"),
    )
    return totals.selectExpr(
        *by,
        "CASE WHEN P > 0 AND N > 0 THEN won / (cast(P AS double) * N) END AS roc_auc",
        "CASE WHEN P > 0 AND N > 0 THEN ap / P END AS pr_auc",
    )


def calibration_table(counts: DataFrame, by: Sequence[str] = KEYS, bins: int = 10) -> DataFrame:
    """Equal-frequency score bins: mean prediction, share of positives, count.

    Edges are exact score quantiles with repeats dropped; a bin is closed on the right and the
    lowest edge belongs to the first bin. A constant score gives one bin.
    """
    by = list(by)
    sized = counts.selectExpr(*by, "prob", "pos", "pos + neg AS n")
    cuts = exact_quantiles(sized, by, "prob", [i / bins for i in range(bins + 1)], weight="n")
    edges = cuts.groupBy(*by).agg(F.expr("sort_array(collect_set(quantile)) AS edges"))
    # The first edge is the minimum; the bin is the number of inner edges below the score.
    placed = sized.join(edges, by).selectExpr(
        *by, "prob", "pos", "n", "size(filter(edges, e -> e < prob AND e > edges[0])) AS bin"
    )
    return placed.groupBy(*by, "bin").agg(
        F.expr("sum(prob * n) / sum(n) AS mean_pred"),
        F.expr("sum(pos) / sum(n) AS frac_pos"),
        F.expr("sum(n) AS n"),
    )


def expected_calibration_error(table: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return table.groupBy(*by).agg(F.expr("sum(n * abs(mean_pred - frac_pos)) / sum(n) AS ece"))


def evaluate(preds: DataFrame, bins: int = 10) -> DataFrame:
    """All metrics per (model, scope), folds and pooled, from one pinned table of score counts."""
    counts = score_counts(preds)
    by = list(KEYS)
    return (
        probability_metrics(counts)
        .join(ranking_metrics(counts), by)
        .join(expected_calibration_error(calibration_table(counts, bins=bins)), by)
    )


METRICS = ("roc_auc", "pr_auc", "brier", "log_loss", "ece", "prevalence")


def metrics_long(metrics: DataFrame) -> DataFrame:
    """Stored form: one row per metric, missing values left out."""
    return metrics.unpivot(["model", "scope", "n"], list(METRICS), "metric", "value").where(
        F.col("value").isNotNull()
    )


def fold_means(metrics: DataFrame, reference: str = "har_logit") -> DataFrame:
    """Each metric averaged over folds (years weigh the same) and folds won against a reference."""
    folds = metrics.where(F.col("scope") != "pooled")
    ref = folds.where(F.col("model") == reference).select("scope", F.col("pr_auc").alias("ref"))
    return (
        folds.join(ref, "scope", "left")
        .groupBy("model")
        .agg(
            *[F.avg(c).alias(c) for c in ("pr_auc", "roc_auc", "brier", "log_loss", "ece")],
            F.count_if(F.col("pr_auc") > F.col("ref")).alias("folds_beat_reference"),
        )
    )


def prevalence(assigned: DataFrame) -> DataFrame:
    """Share of positives among each fold's training rows."""
    return assigned.where(F.col("role") == "train").groupBy("fold").agg(F.avg("y").alias("prevalence"))


def prevalence_predictions(assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The constant model: each test row gets its fold's training prevalence."""
    rates = prevalence(assigned)
    test = assigned.where(F.col("role") == "test")
    # One row per fold: a broadcast bounded by the declared folds.
    return test.join(F.broadcast(rates), "fold").select(
        F.lit("prevalence").alias("model"), "fold", *keys, F.col("prevalence").alias("prob"), "y"
    )


def prediction_outcomes(predictions: DataFrame, versions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions joined to outcomes through their version's label; outcomes are never stored."""
    return predictions.join(versions, "version").join(labels, ["label_name", "asset", "as_of_date"])


def best_configuration(scores: DataFrame) -> DataFrame:
    """Arg-min configuration per (model, fold); the earlier grid position wins a tie."""
    return scores.groupBy("model", "fold").agg(
        F.min(F.struct("score", "grid_pos", "params")).alias("best")
    ).select("model", "fold", "best.params", "best.score", "best.grid_pos")


def cv_scores(split_losses: DataFrame) -> DataFrame:
    """Mean inner log loss per configuration over its validation years."""
    return split_losses.groupBy("model", "fold", "grid_pos", "params").agg(
        F.avg("loss").alias("score"), F.count("*").alias("splits")
    )
