"""Data-quality checks and constraint rules, all entities in one pass.

Every check returns rows (check_name, severity, passed, entity, n, sample): ``severity`` is the level
the check carries when it fails, ``n`` the number of violations, ``sample`` the first ten dates.

Raw feeds may repeat a date any number of times, and one entity may dominate. The checks therefore
reduce rows per (asset, date) before they reduce per asset, and the order-dependent ones run in
day blocks that hand their last state to the next block. Rows of a feed never meet a dimension by
asset alone: a few assets would put the feed into a few tasks, each of which sorts its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ln
from ..settings import QualityRules

CHECK_COLUMNS = ("check_name", "severity", "passed", "entity", "n", "sample")


def first_dates(dates: Column, n: int = 10) -> Column:
    """Aggregate: the first ``n`` distinct dates as text (a set of dates is calendar-bounded)."""
    return F.array_join(F.transform(F.slice(F.sort_array(F.collect_set(dates)), 1, n), lambda d: F.date_format(d, "yyyy-MM-dd")), ",")


def _check(name: str, severity: str | Column, n: Column, sample: Column | None = None, passed: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (n == 0 if passed is None else passed).alias("passed"),
        n.cast("bigint").alias("n"),
        (F.lit("") if sample is None else sample).alias("sample"),
    )


def _rows(df: DataFrame, entity: str, checks: list[Column]) -> DataFrame:
    return df.select(F.col(entity).alias("entity"), F.inline(F.array(*checks))).select(*CHECK_COLUMNS)


def no_rows(data: DataFrame, wanted: DataFrame, entity: str = "asset") -> DataFrame:
    missing = wanted.select(entity).distinct().join(data.select(entity).distinct(), entity, "left_anti")
    return _rows(missing, entity, [_check("no_rows", "error", F.lit(0), passed=F.lit(False))])


def basic_checks(feed: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Duplicate dates, missing closes, non-positive prices, inverted ranges, closes off the range."""
    prices = [F.col(c) for c in ("open", "high", "low", "close", "adj_close")]
    bad_price = reduce(lambda a, b: a | b, [F.coalesce(c <= 0, F.lit(False)) for c in prices])
    tol = rules.range_tolerance
    outside = F.coalesce(F.col("close") > F.col("high") * (1 + tol), F.lit(False)) | F.coalesce(
        F.col("close") < F.col("low") * (1 - tol), F.lit(False)
    )
    daily = feed.groupBy("asset", "trade_date").agg(
        (F.count("*") - 1).alias("dup"),
        F.count_if(F.col("close").isNull()).alias("null_close"),
        F.count_if(bad_price).alias("nonpos"),
        F.count_if(F.col("high") < F.col("low")).alias("inverted"),
        F.count_if(outside).alias("outside"),
    )
    totals = daily.groupBy("asset").agg(
        *[F.sum(c).alias(c) for c in ("dup", "null_close", "nonpos", "inverted", "outside")],
        first_dates(F.when(F.col("outside") > 0, F.col("trade_date"))).alias("where"),
    )
    return _rows(
        totals,
        "asset",
        [
            _check("duplicate_dates", "error", F.col("dup")),
            _check("null_close", "error", F.col("null_close")),
            _check("non_positive_price", "error", F.col("nonpos")),
            _check("high_below_low", "error", F.col("inverted")),
            _check("close_outside_range", "warn", F.col("outside"), F.col("where")),
        ],
    )


def calendar_checks(feed: DataFrame, calendar: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Dates off the calendar, and calendar days missing between an asset's first and last date."""
    present = feed.select("asset", "trade_date").distinct()
    off = present.join(calendar, "trade_date", "left_anti").groupBy("asset").agg(
        F.count("*").alias("n_off"), first_dates(F.col("trade_date")).alias("off")
    )
    spans = present.groupBy("asset").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    expected = spans.select("asset", F.explode(F.sequence("lo", "hi")).alias("trade_date")).join(
        calendar, "trade_date", "left_semi"
    )
    # The expected rows outnumber the present ones only by the gaps, so one join settles both counts.
    missing = (
        expected.join(present.withColumn("seen", F.lit(True)), ["asset", "trade_date"], "left")
        .groupBy("asset")
        .agg(
            F.count("*").alias("n_expected"),
            F.count_if(F.col("seen").isNull()).alias("n_missing"),
            first_dates(F.when(F.col("seen").isNull(), F.col("trade_date"))).alias("missing"),
        )
    )
    totals = (
        spans.select("asset")
        .join(off, "asset", "left")
        .join(missing, "asset", "left")
        .fillna({"n_off": 0, "n_missing": 0, "n_expected": 0, "off": "", "missing": ""})
    )
    fraction = F.col("n_missing") / F.greatest("n_expected", F.lit(1))
    level = F.when(fraction > rules.max_missing, "error").otherwise("warn")
    return _rows(
        totals,
        "asset",
        [
            _check("non_trading_dates", "error", F.col("n_off"), F.col("off")),
            _check("missing_trading_days", level, F.col("n_missing"), F.col("missing")),
        ],
    )


def _with_previous(seq: DataFrame) -> DataFrame:
    """Rows (asset, trade_date, close, ...) in the order of date and close, with the close before each.

    Rows are sorted in day blocks; a block takes over the greatest close of the day before it.
    """
    local = Window.partitionBy("asset", "trade_date").orderBy("close")
    days = Window.partitionBy("asset").orderBy("trade_date")
    tails = seq.groupBy("asset", "trade_date").agg(F.max("close").alias("tail"))
    tails = tails.select("asset", "trade_date", F.lag("tail").over(days).alias("carried"))
    rows = (
        seq.withColumn("prev", F.lag("close").over(local))
        .withColumn("rn", F.row_number().over(local))
        .join(tails, ["asset", "trade_date"])
        .withColumn("prev", F.when(F.col("rn") == 1, F.col("carried")).otherwise(F.col("prev")))
        .withColumn("same", F.coalesce(F.col("close") == F.col("prev"), F.lit(False)))
    )
    return rows.drop("rn", "carried")


def outlier_checks(feed: DataFrame, assets: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Absolute log returns above the threshold; volatility indices are levels and are skipped."""
    move = F.abs(ln(F.col("close")) - ln(F.col("prev")))
    big = F.coalesce(move > rules.outlier, F.lit(False))
    priced = assets.where(F.col("asset_type") != "volatility_index").select("asset")
    # A number of partitions keeps tasks small where adaptive execution would join many compressible ones.
    parts = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    closes = feed.select("asset", "trade_date", "close").repartition(parts, "asset", "trade_date")
    totals = (
        _with_previous(closes)  # equal closes of a day are adjacent and don't move
        .groupBy("asset")
        .agg(F.count_if(big).alias("n"), first_dates(F.when(big, F.col("trade_date"))).alias("where"))
        .join(priced, "asset", "left_semi")
    )
    return _rows(totals, "asset", [_check("return_outliers", "warn", F.col("n"), F.col("where"))])


def stale_checks(feed: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Longest run of identical consecutive closes; ``n`` is that length."""
    rows = _with_previous(feed.groupBy("asset", "trade_date", "close").agg(F.count("*").alias("rows")))
    local = Window.partitionBy("asset", "trade_date").orderBy("close")
    so_far = Window.partitionBy("asset").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(~F.col("same"), F.struct("trade_date", "close"))
    tails = (
        rows.groupBy("asset", "trade_date")
        .agg(F.max(begins).alias("tail"))
        .select("asset", "trade_date", F.max("tail").over(so_far).alias("open_run"))
    )
    runs = (
        rows.withColumn("begin", F.last(begins, True).over(local))
        .join(tails, ["asset", "trade_date"])
        .groupBy("asset", F.coalesce("begin", "open_run").alias("begin"))
        .agg(F.sum(F.when(F.col("close").isNull(), 1).otherwise(F.col("rows"))).alias("length"))
    )
    totals = runs.groupBy("asset").agg(F.max("length").alias("n"))
    return _rows(
        totals, "asset", [_check("stale_prices", "warn", F.col("n"), passed=F.col("n") < rules.stale_run)]
    )


def _off_calendar(feed: DataFrame, calendar: DataFrame, rules: QualityRules) -> tuple[DataFrame, DataFrame]:
    """(rows marked ``off`` the calendar, per asset the counts, first dates and whether its off rows go)."""
    known = calendar.select("trade_date", F.lit(True).alias("on_cal"))
    end = calendar.select(F.max("trade_date")).scalar()
    marked = feed.join(known, "trade_date", "left").withColumn("off", F.col("on_cal").isNull())
    daily = marked.groupBy("asset", "trade_date").agg(F.count("*").alias("rows"), F.first("off").alias("off"))
    totals = (
        daily.withColumn("late", F.col("trade_date") > end)
        .groupBy("asset")
        .agg(
            F.sum("rows").alias("total"),
            F.sum(F.when(F.col("off"), F.col("rows")).otherwise(0)).alias("n_off"),
            F.sum(F.when(F.col("late"), F.col("rows")).otherwise(0)).alias("n_late"),
            first_dates(F.when(F.col("off"), F.col("trade_date"))).alias("off_days"),
            first_dates(F.when(F.col("late"), F.col("trade_date"))).alias("late_days"),
        )
        .withColumn(
            "drop",
            (F.col("n_late") == 0)
            & (F.col("n_off") > 0)
            & (F.col("n_off") / F.col("total") <= rules.max_off_calendar),
        )
    )
    return marked, totals


def drop_off_calendar(
    feed: DataFrame, calendar: DataFrame, rules: QualityRules = QualityRules()
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, report); the rows dropped are those of ``dropped_rows``. A small share of off-calendar rows is dropped and reported.

    Above the allowed share nothing is dropped, so the calendar check blocks the asset; rows later
    than the calendar's end mean a stale calendar, which drops nothing and blocks.
    """
    marked, totals = _off_calendar(feed, calendar, rules)
    kept = (
        marked.join(totals.where("drop").select("asset", "drop"), "asset", "left")
        .where(~(F.col("off") & F.coalesce("drop", F.lit(False))))
        .select(*feed.columns)
    )
    stale = _rows(
        totals.where(F.col("n_late") > 0),
        "asset",
        [_check("calendar_stale", "error", F.col("n_late"), F.col("late_days"))],
    )
    dropped = _rows(
        totals.where("drop"), "asset", [_check("non_trading_rows_dropped", "warn", F.col("n_off"), F.col("off_days"))]
    )
    return kept, stale.unionByName(dropped)


def dropped_rows(feed: DataFrame, calendar: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(asset, trade_date, close) of every row that ``drop_off_calendar`` drops, repeats included."""
    marked, totals = _off_calendar(feed, calendar, rules)
    return marked.where("off").join(totals.where("drop").select("asset"), "asset", "left_semi").select("asset", "trade_date", "close")


def revision_checks(stored: DataFrame, incoming: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Closes restated by the vendor beyond the tolerance; passes where nothing is stored yet."""
    old = stored.select("asset", "trade_date", F.col("close").alias("old"))
    moved = F.try_divide(F.abs(F.col("close") - F.col("old")), F.col("old")) > rules.revision
    moved = F.coalesce(moved, F.lit(False))
    totals = (
        incoming.select("asset", "trade_date", "close")
        .join(old, ["asset", "trade_date"], "left")
        .groupBy("asset")
        .agg(F.count_if(moved).alias("n"), first_dates(F.when(moved, F.col("trade_date"))).alias("where"))
    )
    return _rows(totals, "asset", [_check("vendor_revision_close", "warn", F.col("n"), F.col("where"))])


def macro_checks(vintages: DataFrame, series: DataFrame, today: Column, rules: QualityRules = QualityRules()) -> DataFrame:
    """First-release lag (vintage series), staleness, and series without rows, which block.

    ``series`` is the dimension (series, frequency, method).
    """
    low, high = rules.macro_lag_days
    firsts = vintages.groupBy("series", "observation_date").agg(F.min("valid_from").alias("first_known"))
    odd = ~F.datediff("first_known", "observation_date").between(low, high)
    totals = (
        firsts.groupBy("series")
        .agg(
            F.count_if(odd).alias("n_odd"),
            first_dates(F.when(odd, F.col("observation_date"))).alias("odd"),
            F.max("observation_date").alias("latest"),
        )
        .join(series, "series", "right")
        .withColumn("age", F.datediff(today, F.col("latest")))
    )
    missing = totals.where(F.col("latest").isNull())
    empty = _rows(missing, "series", [_check("no_rows", "error", F.lit(0), passed=F.lit(False))])
    totals = totals.where(F.col("latest").isNotNull())
    limit = F.when(F.col("frequency") == "daily", rules.max_age_daily).otherwise(rules.max_age_other)
    lag = _rows(
        totals.where(F.col("method") == "alfred_vintage"),
        "series",
        [_check("first_vintage_lag", "warn", F.col("n_odd"), F.col("odd"))],
    )
    fresh = _rows(
        totals,
        "series",
        [
            _check(
                "staleness",
                "warn",
                F.col("age"),
                F.date_format("latest", "yyyy-MM-dd"),
                passed=F.col("age") <= limit,
            )
        ],
    )
    return lag.unionByName(fresh).unionByName(empty)


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for row rules; a rule that is NULL for a row counts as satisfied."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def price_rules() -> dict[str, Column]:
    c = F.col
    return {
        "close_present": c("close").isNotNull(),
        "close_positive": c("close") > 0,
        "open_positive": c("open") > 0,
        "adj_close_positive": c("adj_close") > 0,
        "high_not_below_low": c("high") >= c("low"),
        "volume_not_negative": c("volume") >= 0,
    }


def label_rules() -> dict[str, Column]:
    c = F.col
    return {
        "label_binary": c("y").isin(0, 1),
        "label_and_known_date_together": c("y").isNull() == c("label_known_date").isNull(),
        "known_after_as_of": c("label_known_date") > c("as_of_date"),
    }


def prediction_rules() -> dict[str, Column]:
    return {"probability_in_unit_interval": F.col("prob").between(0, 1)}


def finite_rule(col: str = "value") -> dict[str, Column]:
    v = F.col(col)
    return {"value_finite": ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))}


def enum_rule(name: str, col: str, allowed: tuple[str, ...]) -> dict[str, Column]:
    return {name: F.col(col).isin(*allowed)}


def interval_rule(name: str, low: str, high: str) -> dict[str, Column]:
    return {name: F.col(low) <= F.col(high)}


def filtered_duplicates(df: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Keys that more than one row under ``condition`` has: a unique index over part of the rows."""
    return duplicate_keys(df.where(condition), *keys)


def filtered_absent(df: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Keys of which no row is under ``condition``."""
    return df.groupBy(*keys).agg(F.max(F.coalesce(condition, F.lit(False))).alias("any")).where(~F.col("any")).drop("any")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child key values (with row counts) that have no parent; keys are reduced before the join."""
    return child.groupBy(key).agg(F.count("*").alias("rows")).join(parent.select(key), key, "left_anti")


def overlapping_vintages(vintages: DataFrame) -> DataFrame:
    """Rows whose validity overlaps an earlier row of the same observation."""
    before = (
        Window.partitionBy("series", "observation_date")
        .orderBy("valid_from", "valid_to")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return vintages.withColumn("covered_to", F.max("valid_to").over(before)).where(
        F.col("covered_to") >= F.col("valid_from")
    )


def stored_results(checks: DataFrame) -> DataFrame:
    """Audit rows: a failed check keeps its severity, a passed one is information."""
    details = F.to_json(F.struct(F.col("n").alias("count"), F.col("sample")))
    return checks.select(
        "check_name",
        F.when(F.col("passed"), "info").otherwise(F.col("severity")).alias("severity"),
        "passed",
        "entity",
        details.alias("details"),
    )


def blocked_entities(checks: DataFrame) -> DataFrame:
    """Entities with a failed blocking check, and the names of those checks."""
    failed = checks.where(~F.col("passed") & (F.col("severity") == "error"))
    return failed.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("check_name")), ", ").alias("blocked_by"))
