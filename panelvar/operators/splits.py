"""Purged walk-forward splits.

Folds are a short declared list, so rows meet them inside a projection (filter an array of folds,
explode the matches): no join and no shuffle. Time order is enforced by the label's known date.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DateWindow, Fold


def eligible_rows(frame: DataFrame, required: Sequence[str], start: date, holdout_start: date | None) -> DataFrame:
    """Labelled rows of the modeling period with every required feature; the holdout goes first."""
    day = F.col("as_of_date")
    rows = frame.where(day >= F.lit(start))
    if holdout_start is not None:
        rows = rows.where(day < F.lit(holdout_start))
    return rows.where(F.col("y").isNotNull()).dropna(subset=list(required))


def train_mask(test_start: Column) -> Column:
    known = F.col("label_known_date")
    return known.isNotNull() & (known < test_start)


def _fold_array(folds: Sequence[Fold]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(f.label).alias("fold"), F.lit(f.test_start).alias("start"), F.lit(f.test_end).alias("end"))
            for f in folds
        ]
    )


def assign_folds(rows: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """One row per (row, fold, role): ``train`` when the label was known before the test block."""

    def roles(f: Column) -> Column:
        day = F.col("as_of_date")
        test = (day >= f["start"]) & (day <= f["end"])
        return F.array_compact(
            F.array(
                F.when(train_mask(f["start"]), F.struct(f["fold"].alias("fold"), F.lit("train").alias("role"))),
                F.when(test, F.struct(f["fold"].alias("fold"), F.lit("test").alias("role"))),
            )
        )

    matches = F.flatten(F.transform(_fold_array(folds), roles))
    return rows.select("*", F.inline(matches))


def fold_info(assigned: DataFrame) -> DataFrame:
    """Train span and sizes per fold; folds without train or test rows are left out."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    day = F.col("as_of_date")
    return (
        assigned.groupBy("fold")
        .agg(
            F.min(F.when(train, day)).alias("train_start"),
            F.max(F.when(train, day)).alias("train_end"),
            F.count_if(train).alias("n_train"),
            F.count_if(test).alias("n_test"),
            F.sum(F.when(test, F.col("y"))).alias("positives"),
        )
        .where((F.col("n_train") > 0) & (F.col("n_test") > 0))
    )


def inner_splits(train: DataFrame, n_years: int = 3, min_rows: int = 500) -> DataFrame:
    """Inner validation years of each fold's training rows: (fold, year, n_train, n_val).

    The last ``n_years`` calendar years with training rows; a split needs ``min_rows`` rows whose
    labels were known before the year, both classes among them, and validation rows. Everything is
    read off one table of counts per (fold, row year, known year, label).
    """
    cells = train.groupBy(
        "fold",
        F.year("as_of_date").alias("year"),
        F.year("label_known_date").alias("known_year"),
        "y",
    ).agg(F.count("*").alias("n"))
    years = cells.groupBy("fold", "year").agg(F.sum("n").alias("n_val"))
    last = years.withColumn(
        "rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("year")))
    ).where(F.col("rank") <= n_years)
    # Known strictly before 1 January of the year is the same as a known year below it.
    before = cells.select("fold", "known_year", "y", "n")
    return (
        last.join(before, "fold")
        .where(F.col("known_year") < F.col("year"))
        .groupBy("fold", "year", "n_val")
        .agg(F.sum("n").alias("n_train"), F.countDistinct("y").alias("classes"))
        .where((F.col("n_train") >= min_rows) & (F.col("classes") == 2))
        .select("fold", "year", "n_train", "n_val")
    )


def in_windows(rows: DataFrame, windows: Sequence[DateWindow], day: str, name: str) -> DataFrame:
    """Rows tagged with every declared date window that contains them (bounds included)."""
    spans = F.array(
        *[
            F.struct(F.lit(w.name).alias(name), F.lit(w.start).alias("start"), F.lit(w.end).alias("end"))
            for w in windows
        ]
    )
    hits = F.filter(spans, lambda w: F.col(day).between(w["start"], w["end"]))
    return rows.select("*", F.explode(hits).alias("_w")).select(*rows.columns, F.col(f"_w.{name}").alias(name))


def parameter_grid(spark, space: dict[str, Sequence[float]]) -> DataFrame:
    """Every combination of the declared values, numbered in declaration order (grid_pos)."""
    out = spark.range(1).select(F.lit(0).alias("grid_pos"))
    for name, values in space.items():
        options = F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("_i", name)
        out = out.select("*", options)
        out = out.withColumn("grid_pos", F.col("grid_pos") * len(values) + F.col("_i")).drop("_i")
    return out
