"""Idempotent writes on file tables and the row shaping they need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def latest_wins(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert result: the incoming row of a key replaces the stored one, new keys are added.

    The stored table (unique by key) is only probed: a small refresh is broadcast by the planner, so
    stored rows are neither shuffled nor aggregated. If the refresh repeats a key, its greatest row wins.
    """
    columns = stored.columns
    rest = [c for c in columns if c not in keys]
    fresh = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    fresh = fresh.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*columns)
    return stored.join(fresh.select(*keys), list(keys), "left_anti").select(*columns).unionByName(fresh)


def replace_partition_rows(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Whole-key replacement (delete and insert): stored rows of any incoming key are dropped."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace only the partitions present in ``df`` (dynamic partition overwrite)."""
    (
        df.repartition(*keys, F.year("trade_date"))
        if "trade_date" in df.columns
        else df.repartition(*keys)
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A store written by ``upsert_years`` or ``replace_keys``; without rows as long as nothing was written."""
    try:
        return spark.read.parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert_years(incoming: DataFrame, path: str, keys: Sequence[str], day: str = "trade_date") -> None:
    """Upsert into a store partitioned by year: only the years of ``incoming`` are read and rewritten.

    Spark stages the new files and swaps them in when the job commits. ``incoming`` must not read the
    store. A year may be of any size: its rows are spread over as many files as its bytes ask for.
    """
    spark = incoming.sparkSession
    fresh = incoming.withColumn("year", F.year(day))
    years = sorted(r.year for r in fresh.select("year").distinct().collect())  # bounded by the calendar
    if not years:
        return
    stored = read_store(spark, path, fresh.schema).where(F.col("year").isin(years))
    merged = latest_wins(stored, fresh, keys)
    _overwrite_present(merged, path, "year")


def replace_keys(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Delete and insert: partitions of the keys present in ``rows`` are replaced, all others stay."""
    _overwrite_present(rows, path, *keys)


def _overwrite_present(df: DataFrame, path: str, *keys: str) -> None:
    out = df.hint("rebalance", *[F.col(k) for k in keys])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables as CSV with a header; files stay distributed."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def raw_pull_audit(raw: DataFrame, entity: str = "asset") -> DataFrame:
    """One audit row per entity: row count and a SHA-256 that stands for the multiset of its rows.

    Each row is hashed on its own (numbers as millionths). The 16-bit parts of these hashes are
    summed over the entity, and the sums are hashed. Sums combine before the shuffle, so an entity
    costs one row per task, and they don't depend on row order.
    """
    text = F.concat_ws(
        "|",
        F.date_format("trade_date", "yyyy-MM-dd"),
        *[
            F.coalesce(F.floor(F.col(c) * 1e6 + 0.5).cast("string"), F.lit("null"))
            for c in ("open", "high", "low", "close", "adj_close", "volume")
        ],
    )
    rows = raw.select(entity, F.sha2(text, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("bigint")).alias(f"p{k}") for k in range(16)]
    sums = rows.groupBy(entity).agg(F.count("*").alias("row_count"), *parts)
    digest = F.sha2(F.concat_ws(",", *[F.col(f"p{k}").cast("string") for k in range(16)]), 256)
    return sums.select(F.col(entity), "row_count", digest.alias("payload_hash"))


def first_trade_date(prices: DataFrame) -> DataFrame:
    return prices.groupBy("asset").agg(F.min("trade_date").alias("first_trade_date"))


def long_values(wide: DataFrame, keys: Sequence[str], names: Sequence[str], label: str = "name") -> DataFrame:
    """Wide to long, keeping finite values only (a missing value is an absent row)."""
    out = wide.unpivot(list(keys), list(names), label, "value")
    value = F.col("value")
    return out.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def wide_values(long: DataFrame, keys: Sequence[str], names: Sequence[str], label: str = "name") -> DataFrame:
    """Long to wide with the declared names, so no pass over the data is needed to find them."""
    return long.groupBy(*keys).pivot(label, list(names)).agg(F.first("value"))


def calendar_rows(sessions: DataFrame) -> DataFrame:
    """Trading calendar from session close instants (UTC): early close before 16:00 New York time."""
    local = F.from_utc_timestamp("market_close", "America/New_York")
    return sessions.select(
        F.to_date("trade_date").alias("trade_date"),
        ((F.hour(local) * 60 + F.minute(local)) < 16 * 60).alias("is_early_close"),
    )

