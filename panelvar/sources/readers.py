"""Scans and ingest shaping for prices and macro releases."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import OBSERVATIONS_JSON, PRICE_FIELDS, PRICES


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Price files (parquet, csv, json, orc) under the declared schema, whole folder in one scan."""
    options = {"header": "true"} if fmt == "csv" else {}
    return spark.read.format(fmt).schema(PRICES).options(**options).load(path)


def scan_prices(prices: DataFrame, assets: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """Prices of the wanted tickers (all by default) with their dimension columns.

    ``assets`` is joined on its key and left to adaptive execution to broadcast: it grows with the
    panel, so no hint is given. The ticker filter reaches the file scan.
    """
    if wanted is not None:
        prices = prices.where(F.col("asset").isin(list(wanted)))
    return prices.join(assets, "asset", "inner")


def missing_tickers(prices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested tickers that have no price row."""
    return wanted.select("asset").distinct().join(prices, "asset", "left_anti")


def scan_macro(vintages: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    out = vintages.where(F.col("value").isNotNull())
    return out.where(F.col("series").isin(list(wanted))) if wanted is not None else out


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON release files, one payload per line."""
    return parse_observations(spark.read.schema(OBSERVATIONS_JSON).json(path))


def parse_observations(payloads: DataFrame) -> DataFrame:
    """Payload rows (series, observations[]) to vintage rows; the text ``.`` marks a missing value."""
    return (
        payloads.select("series", F.explode("observations").alias("o"))
        .where(F.col("o.value") != ".")
        .select(
            "series",
            F.to_date("o.date").alias("observation_date"),
            F.to_date("o.realtime_start").alias("valid_from"),
            F.to_date("o.realtime_end").alias("valid_to"),
            F.col("o.value").cast("double").alias("value"),
        )
    )


def rename_vendor_columns(raw: DataFrame, names: Mapping[str, str], ticker: str | None = None) -> DataFrame:
    """Vendor spelling to the price contract; a single-ticker file gets its ticker here."""
    out = raw.withColumnsRenamed(dict(names))
    return out.withColumn("asset", F.lit(ticker)) if ticker is not None else out


def union_frames(frames: Iterable[DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    if out is None:
        raise ValueError("no frame to union")
    return out


def _number(name: str, kind: str) -> Column:
    value = F.col(name).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return (F.floor(value) if kind == "bigint" else value).cast(kind).alias(name)


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Typed rows of the price contract: midnight dates, unreadable or NaN numbers become NULL."""
    day = F.col("trade_date")
    if isinstance(raw.schema["trade_date"].dataType, T.StringType):
        day = day.try_cast("timestamp")
    return raw.select(
        "asset",
        F.to_date(day).alias("trade_date"),
        *[_number(c, "bigint" if c == "volume" else "double") for c in PRICE_FIELDS],
    )
