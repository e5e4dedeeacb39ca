"""Declared schemas. Reads enforce them; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")

PRICES = T.StructType(
    [T.StructField("asset", T.StringType(), False), T.StructField("trade_date", T.DateType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_FIELDS[:-1]]
    + [T.StructField("volume", T.LongType())]
)

ASSETS = T.StructType(
    [
        T.StructField("asset", T.StringType(), False),
        T.StructField("asset_type", T.StringType(), False),
        T.StructField("sector", T.StringType()),
    ]
)

VINTAGES = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("observation_date", T.DateType(), False),
        T.StructField("valid_from", T.DateType(), False),
        T.StructField("valid_to", T.DateType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

# Release payload of one series: an array of dated observations, values as text.
OBSERVATIONS_JSON = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField(
            "observations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("date", T.StringType()),
                        T.StructField("realtime_start", T.StringType()),
                        T.StructField("realtime_end", T.StringType()),
                        T.StructField("value", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

DQ_COLUMNS = ("check_name", "severity", "passed", "entity", "details")
