"""Gated price load: every asset passes the checks or leaves the store as it was.

A load keeps the raw pull, judges each asset on what was kept, upserts the rows of the assets that
pass, and closes its ledger entry last. Each step is a Spark write that replaces its own target, so a
load that died half-way is run again under the same id with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin
from ..settings import QualityRules
from ..sources import readers, sinks
from . import ledger, quality


@dataclass(frozen=True)
class Gate:
    """What one pull may change: accepted rows, dropped rows, all checks, one verdict per wanted asset."""

    accepted: DataFrame
    dropped: DataFrame
    checks: DataFrame
    verdicts: DataFrame


def check_limits(rules: QualityRules) -> dict[str, float]:
    """The threshold behind each check that has one."""
    return {
        "return_outliers": rules.outlier,
        "stale_prices": float(rules.stale_run),
        "missing_trading_days": rules.max_missing,
        "non_trading_rows_dropped": rules.max_off_calendar,
        "vendor_revision_close": rules.revision,
        "close_outside_range": rules.range_tolerance,
    }


def _limit(rules: QualityRules) -> Column:
    out = F.lit(None).cast("double")
    for name, value in check_limits(rules).items():
        out = F.when(F.col("check_name") == name, F.lit(value)).otherwise(out)
    return out


def gate(
    feed: DataFrame,
    wanted: DataFrame,
    assets: DataFrame,
    calendar: DataFrame,
    stored: DataFrame,
    rules: QualityRules = QualityRules(),
) -> Gate:
    """Checks of one pull. An asset with a failed error check is blocked as a whole.

    Rows of assets that were not asked for take no part. A wanted asset that the dimension lacks, or
    that has no rows, is blocked. ``checks`` carry the rows judged, the share of violations and the
    limit. Checks and verdicts have some rows per asset and are pinned: three outputs read them.
    Each check is pinned on its own first: their union is partitioned alike, so that one task would
    run all of them and hold the sort and hash memory of all until its end.
    """
    # Small tables that every check reads: derived from the feed's source once.
    wanted, assets, calendar = pin(wanted.select("asset").distinct()), pin(assets), pin(calendar)
    known = wanted.join(assets.select("asset"), "asset", "left_semi")
    rows = feed.join(known, "asset", "left_semi")
    kept, drops = quality.drop_off_calendar(rows, calendar, rules)
    unknown = wanted.join(assets.select("asset"), "asset", "left_anti").select(
        F.lit("unknown_asset").alias("check_name"),
        F.lit("error").alias("severity"),
        F.lit(False).alias("passed"),
        F.col("asset").alias("entity"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit("").alias("sample"),
    )
    found = readers.union_frames(
        pin(rows_of)
        for rows_of in (
            quality.basic_checks(kept, rules),
            quality.no_rows(kept, known),
            quality.calendar_checks(kept, calendar, rules),
            quality.outlier_checks(kept, assets, rules),
            quality.stale_checks(kept, rules),
            quality.revision_checks(stored, kept, rules),
            drops,
            unknown,
        )
    )
    judged = rows.groupBy(F.col("asset").alias("entity")).agg(F.count("*").alias("rows_judged"))
    checks = pin(
        found.join(judged, "entity", "left")
        .fillna({"rows_judged": 0})
        .select(
            *quality.CHECK_COLUMNS,
            "rows_judged",
            F.try_divide(F.col("n"), F.col("rows_judged")).alias("fraction"),
            _limit(rules).alias("limit"),
        )
    )
    blocked = quality.blocked_entities(checks).withColumnRenamed("entity", "asset")
    verdicts = pin(wanted.join(blocked, "asset", "left"))
    passed = verdicts.where(F.col("blocked_by").isNull()).select("asset")
    return Gate(
        accepted=kept.join(passed, "asset", "left_semi").select(*feed.columns),
        dropped=quality.dropped_rows(rows, calendar, rules),
        checks=checks,
        verdicts=verdicts,
    )


def load_prices(
    spark: SparkSession,
    root: str,
    run_id: str,
    feed: DataFrame,
    wanted: DataFrame,
    assets: DataFrame,
    calendar: DataFrame,
    rules: QualityRules = QualityRules(),
) -> bool:
    """Load one pull into the store below ``root``; true if no wanted asset was blocked.

    Written, each under ``run_id``: ``pulls`` (the payload as it came) and ``pull_audit``, ``checks``,
    ``verdicts``, ``dropped``; then ``prices``, where only the years that accepted rows touch are
    rewritten; last the closing row of ``runs``. An error closes the run as failed and is raised.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}/run_id={run_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def note(status: str, **counts) -> None:
        event = ledger.run_event(spark, run_id, "load_prices", status, **counts)
        event.coalesce(1).write.mode("append").parquet(f"{root}/runs")

    note("running")
    try:
        pull = keep(feed, "pulls")
        keep(sinks.raw_pull_audit(pull), "pull_audit")
        stored = sinks.read_store(spark, f"{root}/prices", feed.schema)
        result = gate(pull, wanted, assets, calendar, stored, rules)
        keep(result.checks, "checks")
        keep(result.verdicts, "verdicts")
        keep(result.dropped, "dropped")
        accepted = keep(result.accepted, "accepted")
        sinks.upsert_years(accepted, f"{root}/prices", ("asset", "trade_date"))
        blocked = result.verdicts.where(F.col("blocked_by").isNotNull()).count()
        read, written = pull.count(), accepted.count()
    except Exception as error:
        note("failed", error=str(error)[:500])
        raise
    note(
        "failed" if blocked else "succeeded",
        rows_read=read,
        rows_written=written,
        error=f"{blocked} assets blocked" if blocked else None,
    )
    return not blocked
