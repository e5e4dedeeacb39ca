"""Append-only run ledger, table fingerprints and snapshot comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, pipeline string, event_ts timestamp, status string, rows_read long, rows_written long, error string"
)


def run_event(
    spark: SparkSession,
    run_id: str,
    pipeline: str,
    status: str,
    rows_read: int | None = None,
    rows_written: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """One ledger row: ``running`` at the start, ``succeeded`` or ``failed`` at the end."""
    row = [(run_id, pipeline, None, status, rows_read, rows_written, error)]
    return spark.createDataFrame(row, RUN_SCHEMA).withColumn("event_ts", F.current_timestamp())


def run_status(ledger: DataFrame) -> DataFrame:
    """Current state per run: start, finish, last status and counts."""
    done = F.col("status") != "running"
    return ledger.groupBy("run_id", "pipeline").agg(
        F.min("event_ts").alias("started_at"),
        F.max(F.when(done, F.col("event_ts"))).alias("finished_at"),
        F.max_by("status", "event_ts").alias("status"),
        F.max("rows_read").alias("rows_read"),
        F.max("rows_written").alias("rows_written"),
        F.max("error").alias("error"),
    )


def succeeded_runs(ledger: DataFrame) -> DataFrame:
    """Succeeded runs per pipeline, the guard of a single-use evaluation."""
    return run_status(ledger).groupBy("pipeline").agg(F.count_if(F.col("status") == "succeeded").alias("succeeded"))


def _row_hash(columns: Sequence[str]):
    return F.xxhash64(*[F.col(c) for c in columns])


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent fingerprint of a table: row count, XOR and sum of 64-bit row hashes."""
    columns = sorted(columns or df.columns)
    h = _row_hash(columns)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added, removed and modified keys between two snapshots, by row hash."""
    rest = sorted(c for c in old.columns if c not in keys)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias(name))

    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    joined = side(old, "old_hash").join(side(new, "new_hash"), list(keys), "full_outer")
    return joined.select(*keys, kind.alias("change")).where(F.col("change").isNotNull())
