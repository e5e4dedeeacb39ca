"""Adapter from the driver's tables to the panel.

Every table is read whole. Line items aggregate to one price row per (line number, ship date) and
orders to macro releases; both aggregates combine map-side, so the hot line number costs one partial
row per task and date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import OPEN_END, DateWindow, Fold, PanelRoles, yearly_folds
from . import schemas


ROLES = PanelRoles(
    market="A1",
    implied_vol="A7",
    volume="A5",
    sector=("A1", "A2", "A3"),  # the densest: a member's gap leaves 21 days without a correlation
    credit=("A5", "A6"),
    policy_rate="D_F",
    ten_year="D_O",
    two_year="D_P",
    term_spread="D_ALL",
    unemployment="1-URGENT",
    price_index="2-HIGH",
)
#: Assets that the dimension table calls sector funds.
SECTOR_ETFS = ("A2", "A3", "A4")
IMPLIED_SCALE = 997.0
MACRO_SCALE = 99_991.0
PORTFOLIO = {"A1": 0.6, "A2": 0.4}
JOINT_SHOCKS = {
    "both_fall": {"A1": -0.20, "A2": -0.10},
    "second_rises": {"A1": -0.20, "A2": 0.05},
}
MODELING_START = date(1996, 6, 1)
HOLDOUT_START = date(2001, 1, 1)
WALK_FORWARD: list[Fold] = yearly_folds(1998, 2000)
HOLDOUT: list[Fold] = yearly_folds(2001, 2001, "holdout")
EPISODES = [
    DateWindow("autumn_1998", date(1998, 8, 1), date(1998, 11, 30)),
    DateWindow("year_2000", date(2000, 1, 1), date(2000, 12, 31)),
]
REPLAYS = [
    DateWindow("asia_1997", date(1997, 10, 1), date(1998, 1, 15)),
    DateWindow("ltcm_1998", date(1998, 7, 17), date(1998, 10, 8)),
    DateWindow("dotcom_2000", date(2000, 3, 10), date(2001, 4, 4)),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_name(col: str = "l_linenumber") -> Column:
    return F.concat(F.lit("A"), F.col(col).cast("string"))


def mean_amount(amount: Column | str) -> Column:
    """Mean of a two-decimal amount from an exact integer sum, so it does not depend on row order."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    cents = F.sum(F.round(amount * 100).cast("bigint"))
    return F.try_divide(cents.cast("double"), F.count(amount) * F.lit(100.0))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per line number: (asset, date) unique by construction.

    The open is the price of the line with the smallest (order key, price). Both stand in one decimal
    number (the last 15 digits are cents), whose buffer is of fixed size, so the aggregate stays on
    the hash path; a struct would sort. Keys up to 2^63 and prices below 10^13 fit.
    """
    items = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    cents = F.round(price * 100).cast("bigint")
    shift = F.lit(10**15).cast("decimal(16,0)")
    first = F.min((F.col("l_orderkey").cast("decimal(19,0)") * shift + cents.cast("decimal(15,0)")).cast("decimal(38,0)"))
    return (
        items.groupBy("l_linenumber", "l_shipdate")
        .agg(
            ((first % shift).cast("bigint") / 100.0).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            mean_amount("l_extendedprice").alias("close"),
            F.sum("l_quantity").cast("bigint").alias("volume"),
        )
        .select(
            asset_name().alias("asset"),
            F.to_date("l_shipdate").alias("trade_date"),
            "open",
            "high",
            "low",
            "close",
            F.col("close").alias("adj_close"),
            "volume",
        )
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-aggregated vendor feed, one row per line item: repeated dates are real here."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        asset_name().alias("asset"),
        F.to_date("l_shipdate").alias("trade_date"),
        (price * (1 - F.col("l_discount"))).alias("open"),
        price.alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"),
        price.alias("close"),
        price.alias("adj_close"),
        F.col("l_quantity").cast("bigint").alias("volume"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days: distinct ship dates, closed on 25 December of leap years."""
    day = F.to_date("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .select(day.alias("trade_date"))
        .distinct()
        .where(~((F.date_format("trade_date", "MM-dd") == "12-25") & (F.year("trade_date") % 4 == 0)))
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset dimension, one row per line number."""
    name = F.col("asset")
    return (
        table(spark, sf_dir, "lineitem")
        .select(asset_name().alias("asset"))
        .distinct()
        .select(
            name,
            F.when(name == ROLES.implied_vol, "volatility_index")
            .when(name == ROLES.market, "index")
            .otherwise("etf")
            .alias("asset_type"),
            F.when(name.isin(*SECTOR_ETFS), F.concat(F.lit("S"), F.substring(name, 2, 10))).alias("sector"),
        )
    )


def daily_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily unrevised series (series, observation_date, value): one per order status and one overall."""
    orders = table(spark, sf_dir, "orders")
    return (
        orders.select(
            F.explode(F.array(F.concat(F.lit("D_"), "o_orderstatus"), F.lit("D_ALL"))).alias("series"),
            F.to_date("o_orderdate").alias("observation_date"),
            "o_totalprice",
        )
        .groupBy("series", "observation_date")
        .agg((mean_amount("o_totalprice") / MACRO_SCALE).alias("value"))
    )


def monthly_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series per order priority: a first release (half month) and a revision (full month)."""
    orders = table(spark, sf_dir, "orders")
    early = F.dayofmonth("o_orderdate") <= 15
    monthly = orders.groupBy(
        F.col("o_orderpriority").alias("series"),
        F.to_date(F.trunc("o_orderdate", "month")).alias("observation_date"),
    ).agg(
        mean_amount(F.when(early, F.col("o_totalprice"))).alias("first"),
        mean_amount("o_totalprice").alias("revised"),
    )
    obs = F.col("observation_date")
    releases = F.array(
        F.struct(F.date_add(obs, 35).alias("f"), F.date_add(obs, 119).alias("t"), F.col("first").alias("v")),
        F.struct(F.date_add(obs, 120).alias("f"), F.lit(OPEN_END).alias("t"), F.col("revised").alias("v")),
    )
    return (
        monthly.select("series", "observation_date", F.explode(releases).alias("r"))
        .where(F.col("r.v").isNotNull())
        .select(
            "series",
            "observation_date",
            F.col("r.f").alias("valid_from"),
            F.col("r.t").alias("valid_to"),
            F.col("r.v").alias("value"),
        )
    )


def observation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON release payloads built from the event properties, one document per event."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.to_json(
        F.struct(
            F.col("event_type").alias("series"),
            F.array(
                F.struct(
                    day.alias("date"),
                    F.date_format(F.date_add(F.to_date("ts"), k), "yyyy-MM-dd").alias("realtime_start"),
                    F.lit("9999-12-31").alias("realtime_end"),
                    F.when(k % 10 == 0, F.lit(".")).otherwise(F.col("value").cast("string")).alias("value"),
                )
            ).alias("observations"),
        )
    )
    return events.select("event_id", text.alias("payload")).select(
        "event_id", F.from_json("payload", schemas.OBSERVATIONS_JSON).alias("p")
    ).select("event_id", "p.series", "p.observations")


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored outcomes: model = label kind, fold = language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    score = F.round(1 / (1 + F.exp(-(F.log(F.col("n_chars") + 1.0) - 6.0))), 3)
    return (
        labels.join(docs, "doc_id")
        .select(
            F.col("lang").alias("fold"),
            "doc_id",
            F.explode(
                F.array(
                    F.struct(F.lit("quality").alias("model"), F.col("quality").alias("y"), score.alias("prob")),
                    F.struct(F.lit("toxic").alias("model"), F.col("toxic").alias("y"), (1 - score).alias("prob")),
                )
            ).alias("m"),
        )
        .select("m.model", "fold", "doc_id", "m.prob", F.col("m.y").cast("int").alias("y"))
    )
