"""Point-in-time lookups of macro releases.

A vintage carries the value of an observation and the days on which that value stood, both ends
included: ``valid_from`` and ``valid_to``. None of the lookups pairs every date with every vintage: each one is an
equi-join, so work grows with dates plus vintages, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import OPEN_END



def asof_daily(vintages: DataFrame, dates: DataFrame) -> DataFrame:
    """Daily unrevised series on each date: the newest release at or before it.

    ``valid_to`` plays no part; among the releases of one day the latest observation counts. Each
    release covers the days until the next one (no day at all when the next comes on the same day),
    so the lookup is an equi-join on the day. ``dates`` holds distinct days.
    Returns (series, as_of_date, value).
    """
    last = dates.select(F.max("as_of_date")).scalar()
    spans = (
        vintages.where("value IS NOT NULL")
        .selectExpr(
            "series",
            "value",
            "valid_from",
            "lead(valid_from) OVER (PARTITION BY series ORDER BY valid_from, observation_date) AS next_from",
        )
        .withColumn("until", F.coalesce(F.expr("date_sub(next_from, 1)"), last))
        .where("valid_from <= until")
    )
    days = spans.selectExpr("series", "value", "explode(sequence(valid_from, until)) AS as_of_date")
    return days.join(dates, "as_of_date", "left_semi").select("series", "as_of_date", "value")


# Day numbers count from 0001-01-01, and 22 doublings of a day reach past 9999-12-31.
_DAY_ZERO = 719_162
_LEVELS = 22


def _day(col: str) -> str:
    return f"(unix_date({col}) + {_DAY_ZERO})"


def pit_latest(vintages: DataFrame, dates: DataFrame) -> DataFrame:
    """Newest observation known on each date, from rows with valid_from <= date <= valid_to.

    Each validity interval is cut into aligned power-of-two blocks of days that cover it exactly,
    and each date looks up the blocks that contain it, one per level. Blocks are reduced to their
    newest observation before the join, so a long-lived vintage costs a handful of rows, never one
    per day. The block of level k that starts at day n * 2^k has the id n * 32 + k. ``dates`` holds
    distinct days. Returns (series, as_of_date, observation_date, value); dates with nothing known
    are absent.
    """
    low, high = "shiftright(a + shiftleft(1, k) - 1, k)", "shiftright(b + 1, k)"
    cover = (
        f"array_compact(flatten(transform(sequence(0, {_LEVELS}), k -> array("
        f"CASE WHEN {low} < {high} AND {low} % 2 = 1 THEN {low} * 32 + k END, "
        f"CASE WHEN {low} < {high} AND {high} % 2 = 1 THEN ({high} - 1) * 32 + k END))))"
    )
    blocks = (
        vintages.where("value IS NOT NULL AND valid_from <= valid_to")
        .selectExpr("series", "observation_date", "value", f"{_day('valid_from')} AS a", f"{_day('valid_to')} AS b")
        .selectExpr("series", "struct(observation_date, -a AS k, value) AS row", f"explode({cover}) AS block")
        .groupBy("series", "block")
        .agg(F.expr("max(row) AS row"))
    )
    above = f"transform(sequence(0, {_LEVELS}), k -> shiftright({_day('as_of_date')}, k) * 32 + k)"
    lookups = dates.selectExpr("as_of_date", f"explode({above}) AS block")
    return (
        blocks.join(lookups, "block")
        .groupBy("series", "as_of_date")
        .agg(F.expr("max(row) AS row"))
        .selectExpr("series", "as_of_date", "row.observation_date", "row.value")
    )


def pit_lagged(vintages: DataFrame, dates: DataFrame, lag_months: int | dict[str, int]) -> DataFrame:
    """Latest value and the value ``lag_months`` before it, both from the same snapshot.

    The lag is one number, or one per series. The lagged month is matched on (series, month), so
    only the few revisions of that one month are tested against the date.
    Returns (series, as_of_date, latest, lagged).
    """
    if isinstance(lag_months, dict):
        vintages = vintages.where(F.col("series").isin(*lag_months))
        lag = "CASE series " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in lag_months.items()) + " END"
    else:
        lag = str(lag_months)
    month = "year(observation_date) * 12 + month(observation_date)"
    latest = pit_latest(vintages, dates).selectExpr("series", "as_of_date", "value", f"{month} - {lag} AS month")
    known = vintages.where("value IS NOT NULL").selectExpr(
        "series", f"{month} AS month", "valid_from", "valid_to", "value AS old"
    )
    valid = "as_of_date BETWEEN valid_from AND valid_to"
    return (
        latest.join(known, ["series", "month"], "left")
        .groupBy("series", "as_of_date")
        .agg(
            F.expr("first(value) AS latest"),
            F.expr(f"min_by(CASE WHEN {valid} THEN old END, CASE WHEN {valid} THEN valid_from END) AS lagged"),
        )
    )


def truncate_vintages(vintages: DataFrame, as_of: Column) -> DataFrame:
    """The vintage table as it stood at the close of ``as_of``."""
    return vintages.where(F.col("valid_from") <= as_of).withColumn(
        "valid_to", F.when(F.col("valid_to") > as_of, F.lit(OPEN_END)).otherwise(F.col("valid_to"))
    )


def truncate_prices(prices: DataFrame, as_of: Column, day: str = "trade_date") -> DataFrame:
    return prices.where(F.col(day) <= as_of)


# Observed US federal holidays. Fixed dates move off a weekend (Saturday to Friday,
# Sunday to Monday); the others are the n-th weekday of a month (1 = Sunday ... 7 = Saturday).
_FIXED_DATES = (("01-01", 0), ("06-19", 2021), ("07-04", 0), ("11-11", 0), ("12-25", 0))
_WEEKDAY_RULES = ((1, 2, 15, 21, 1986), (2, 2, 15, 21, 0), (5, 2, 25, 31, 0), (9, 2, 1, 7, 0), (10, 2, 8, 14, 0), (11, 5, 22, 28, 0))


def is_federal_holiday(day: str) -> str:
    """SQL text: true when a weekday is an observed federal holiday."""
    fixed = []
    for date_text, since in _FIXED_DATES:
        for shift, weekday in ((0, None), (1, 6), (-1, 2)):
            moved = f"date_add({day}, {shift})"
            rule = f"date_format({moved}, 'MM-dd') = '{date_text}' AND year({moved}) >= {since}"
            fixed.append(f"({rule} AND dayofweek({day}) = {weekday})" if weekday else f"({rule})")
    nth = [
        f"(month({day}) = {m} AND dayofweek({day}) = {dow} AND dayofmonth({day}) BETWEEN {lo} AND {hi} AND year({day}) >= {since})"
        for m, dow, lo, hi, since in _WEEKDAY_RULES
    ]
    return "(" + " OR ".join(fixed + nth) + ")"


def next_business_day(day: str) -> str:
    """SQL text: the first federal business day after ``day`` (never more than a week away)."""
    weekday = "dayofweek(x) BETWEEN 2 AND 6"
    return f"element_at(filter(sequence(date_add({day}, 1), date_add({day}, 7)), x -> {weekday} AND NOT {is_federal_holiday('x')}), 1)"


def rule_lag(observations: DataFrame) -> DataFrame:
    """Daily unrevised observations become known on the next federal business day, with an open end.

    The holiday rules are part of the expression, so no lookup table and no join is needed.
    """
    return observations.selectExpr(
        "series",
        "observation_date",
        f"{next_business_day('observation_date')} AS valid_from",
        f"date'{OPEN_END.isoformat()}' AS valid_to",
        "value",
    )


def cash_rate(prices: DataFrame, daily: DataFrame, series: str) -> DataFrame:
    """(asset, trade_date, cash): policy rate known on the previous row, as a daily simple rate."""
    dates = prices.select(F.col("trade_date").alias("as_of_date")).distinct()
    known = asof_daily(daily.where(F.col("series") == series), dates).select(
        F.col("as_of_date").alias("trade_date"), "value"
    )
    # One row per calendar day at most: a bounded broadcast.
    joined = prices.select("asset", "trade_date").join(F.broadcast(known), "trade_date", "left")
    w = Window.partitionBy("asset").orderBy("trade_date")
    return joined.select("asset", "trade_date", (F.lag("value").over(w) / 100 / 252).alias("cash"))
