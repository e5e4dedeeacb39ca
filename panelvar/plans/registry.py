"""Named queries over the driver's tables. Each one reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import evaluations, garch, inference, ledger, load, overlay, pit, risk, splits
from ..operators import labels as lb
from ..operators import metrics as metrics_
from ..operators import models
from ..operators import quality as dq
from ..session import pin, scratch_folder
from ..functions import recursion
from ..settings import OPEN_END, Fold, OverlaySettings, RiskSettings, Target, InferenceSettings
from ..sources import panel, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Panel:
    """Lazy plans over one data folder; nothing runs until a query is executed."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def prices(self) -> DataFrame:
        return panel.prices(self.spark, self.sf_dir)

    @cached_property
    def stored(self) -> DataFrame:
        """The daily price table as the load leaves it: written once, read by every later branch."""
        return pin(self.prices)

    @cached_property
    def feed(self) -> DataFrame:
        return panel.raw_feed(self.spark, self.sf_dir)

    @cached_property
    def calendar(self) -> DataFrame:
        return panel.calendar(self.spark, self.sf_dir)

    @cached_property
    def assets(self) -> DataFrame:
        return panel.assets(self.spark, self.sf_dir)

    @cached_property
    def dates(self) -> DataFrame:
        """Every date of the panel: calendar-sized, read by several branches of a lookup."""
        return pin(self.prices.select(F.col("trade_date").alias("as_of_date")).distinct())

    @cached_property
    def daily(self) -> DataFrame:
        return pit.rule_lag(panel.daily_observations(self.spark, self.sf_dir))

    @cached_property
    def monthly(self) -> DataFrame:
        return panel.monthly_vintages(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        return self.some_features(*ft.ALL_FEATURES)

    def some_features(self, *names: str) -> DataFrame:
        return ft.compute_features(self.stored, self.daily, self.monthly, panel.ROLES, panel.IMPLIED_SCALE, names)

    @cached_property
    def labels(self) -> DataFrame:
        return lb.make_labels(self.stored, Target())


def register(fn: Callable[[Panel], DataFrame]) -> Callable[[Panel], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Panel(spark, sf_dir))
    return fn


def tidy(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    """Rounded columns; adding zero turns a negative zero into zero."""
    return df.selectExpr(*[f"round({c}, {digits}) + 0.0D AS {c}" if c in names else f"`{c}`" for c in df.columns])


# ---- scans, ingest, sinks ------------------------------------------------------------------------


@register
def scan_prices(p: Panel) -> DataFrame:
    return readers.scan_prices(p.prices, p.assets)


@register
def scan_macro(p: Panel) -> DataFrame:
    return readers.scan_macro(p.monthly.unionByName(p.daily))


@register
def ingest_macro_json(p: Panel) -> DataFrame:
    return readers.parse_observations(panel.observation_payloads(p.spark, p.sf_dir))


@register
def normalize_prices(p: Panel) -> DataFrame:
    """Text prices with unreadable entries, as a vendor file would deliver them."""
    text = p.prices.select(
        F.col("asset").alias("Ticker"),
        F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("Date"),
        *[F.col(c).cast("string").alias(c.capitalize()) for c in ("open", "high", "low")],
        F.when(F.col("volume") % 50 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("Close"),
        F.col("adj_close").cast("string").alias("Adj Close"),
        F.when(F.col("volume") % 7 == 0, "NaN").otherwise(F.col("volume").cast("string")).alias("Volume"),
    )
    names = {
        "Ticker": "asset",
        "Date": "trade_date",
        "Open": "open",
        "High": "high",
        "Low": "low",
        "Close": "close",
        "Adj Close": "adj_close",
        "Volume": "volume",
    }
    return readers.normalize_prices(readers.rename_vendor_columns(text, names))


@register
def raw_pull_hash(p: Panel) -> DataFrame:
    return sinks.raw_pull_audit(p.feed)


@register
def upsert_prices(p: Panel) -> DataFrame:
    """Stored history through 2000, a refresh from 2000 on with restated closes."""
    year = F.year("trade_date")
    stored = p.prices.where(year <= 2000)
    refresh = p.prices.where(year >= 2000).withColumn("close", F.col("close") * 2)
    return sinks.latest_wins(stored, refresh, ["asset", "trade_date"])


@register
def first_trade_date(p: Panel) -> DataFrame:
    return sinks.first_trade_date(p.prices)


@register
def calendar_upsert(p: Panel) -> DataFrame:
    """Stored days without early closes, refreshed from 1998 on by sessions with closing instants in UTC."""
    day = F.col("trade_date")
    hour = F.when(F.date_format(day, "MM-dd") == "12-24", 18).when(F.dayofmonth(day) == 10, 20).otherwise(21)
    sessions = p.calendar.select("trade_date", (day.cast("timestamp") + F.make_dt_interval(hours=hour)).alias("market_close"))
    stored = p.calendar.where(F.year(day) <= 1999).withColumn("is_early_close", F.lit(False))
    return sinks.latest_wins(stored, sinks.calendar_rows(sessions.where(F.year(day) >= 1998)), ["trade_date"])


@register
def price_files(p: Panel) -> DataFrame:
    """Prices written as CSV and read back through the file source under the declared schema."""
    path = scratch_folder(p.spark, "csv")
    sinks.write_csv(p.prices, path)
    return readers.read_prices(p.spark, path, "csv")


@register
def label_definitions(p: Panel) -> DataFrame:
    """The definition row of the stored labels, with how many rows stand under it."""
    counts = p.labels.groupBy(F.col("label_name").alias("name")).agg(F.count("y").alias("n_labels"))
    return lb.label_definition(p.spark, Target()).join(counts, "name")


@register
def replace_series(p: Panel) -> DataFrame:
    incoming = p.monthly.where(
        F.col("series").isin("1-URGENT", "5-LOW") & (F.col("valid_to") < F.lit(OPEN_END))
    ).withColumn("value", F.col("value") * 2)
    return sinks.replace_partition_rows(p.monthly, incoming, "series")


@register
def feature_sets(p: Panel) -> DataFrame:
    """Members of each feature set with the number of stored values."""
    counts = p.features.agg(*[F.count(c).alias(c) for c in ft.ALL_FEATURES])
    counts = counts.unpivot([], list(ft.ALL_FEATURES), "name", "n_values")
    return ft.feature_sets(ft.registry_frame(p.spark)).join(counts, "name")


@register
def features_core(p: Panel) -> DataFrame:
    return tidy(p.features, *ft.ALL_FEATURES)


@register
def features_long(p: Panel) -> DataFrame:
    return tidy(sinks.long_values(p.features, ["asset", "as_of_date"], ft.ALL_FEATURES), "value")


@register
def features_wide(p: Panel) -> DataFrame:
    keys = ["asset", "as_of_date"]
    long = sinks.long_values(p.features, keys, ft.ALL_FEATURES)
    return tidy(sinks.wide_values(long, keys, ft.ALL_FEATURES), *ft.ALL_FEATURES)


@register
def labels(p: Panel) -> DataFrame:
    return tidy(p.labels, "rv_fwd", "threshold")


@register
def label_prevalence(p: Panel) -> DataFrame:
    return tidy(
        p.labels.groupBy("asset").agg(
            F.count("*").alias("n_rows"),
            F.count("y").alias("n_labels"),
            F.sum("y").alias("positives"),
            F.avg("y").alias("prevalence"),
            F.avg("rv_fwd").alias("mean_rv"),
            F.avg("threshold").alias("mean_threshold"),
        ),
        "prevalence",
        "mean_rv",
        "mean_threshold",
    )


# ---- point in time -------------------------------------------------------------------------------


@register
def asof_daily(p: Panel) -> DataFrame:
    return pit.asof_daily(p.daily, p.dates)


@register
def pit_latest(p: Panel) -> DataFrame:
    return pit.pit_latest(p.monthly, p.dates)


@register
def pit_lagged(p: Panel) -> DataFrame:
    out = [pit.pit_lagged(p.monthly, p.dates, k).withColumn("lag_months", F.lit(k)) for k in (1, 12)]
    return readers.union_frames(out)


@register
def rule_lag(p: Panel) -> DataFrame:
    return p.daily


@register
def truncate_asof(p: Panel) -> DataFrame:
    as_of = F.lit("1999-06-30").cast("date")
    macro = pit.truncate_vintages(p.monthly, as_of)
    price = pit.truncate_prices(p.prices, as_of)
    return (
        macro.groupBy("series")
        .agg(
            F.count("*").alias("n"),
            F.max("valid_from").alias("newest"),
            F.count_if(F.col("valid_to") == F.lit(OPEN_END)).alias("still_open"),
        )
        .select(F.lit("macro").alias("kind"), F.col("series").alias("entity"), "n", "newest", "still_open")
        .unionByName(
            price.groupBy("asset")
            .agg(F.count("*").alias("n"), F.max("trade_date").alias("newest"))
            .select(
                F.lit("price").alias("kind"),
                F.col("asset").alias("entity"),
                "n",
                "newest",
                F.lit(0).cast("bigint").alias("still_open"),
            )
        )
    )


@register
def cash_rate(p: Panel) -> DataFrame:
    return tidy(pit.cash_rate(p.prices, p.daily, panel.ROLES.policy_rate), "cash", digits=10)


# ---- single features -----------------------------------------------------------------------------


@register
def log_returns(p: Panel) -> DataFrame:
    names = [f"ret_{k}d" for k in (1, 5, 21, 63)]
    return tidy(lb.log_returns(p.prices, (1, 5, 21, 63)).select("asset", "trade_date", *names), *names)


def _price_feature(*names: str) -> Callable[[Panel], DataFrame]:
    return lambda p: tidy(ft.price_features(p.prices).select("asset", "trade_date", *names), *names)


def _panel_feature(*names: str) -> Callable[[Panel], DataFrame]:
    return lambda p: tidy(p.some_features(*names), *names)


for _key, _query in {
    "realized_vol": _price_feature("rv_5d", "rv_21d", "rv_63d"),
    "semidev": _price_feature("semidev_21d"),
    "drawdown_252": _price_feature("drawdown_252d"),
    "parkinson": _price_feature("parkinson_21d"),
    "garman_klass": _price_feature("garman_klass_21d"),
    "level_changes": _panel_feature(
        "vix_chg_1d", "vix_chg_5d", "dff_chg_21d", "dgs10_chg_5d", "dgs10_chg_21d", "dgs2_chg_5d"
    ),
    "volume_ratio": _panel_feature("spy_volume_ratio_21d"),
    "ratio_change": _panel_feature("hyg_lqd_chg_5d"),
}.items():
    QUERIES[_key] = lambda spark, sf_dir, q=_query: q(Panel(spark, sf_dir))


def _cross_section(p: Panel) -> DataFrame:
    members = ft.member_returns(ft.market_series(p.prices, panel.ROLES), panel.ROLES.sector)
    return ft.cross_section(members, len(panel.ROLES.sector))


@register
def sector_dispersion(p: Panel) -> DataFrame:
    return tidy(_cross_section(p).drop("sector_avgcorr_21d"), "sector_dispersion_1d")


@register
def avg_pair_corr(p: Panel) -> DataFrame:
    out = _cross_section(p).drop("sector_dispersion_1d").where(F.col("sector_avgcorr_21d").isNotNull())
    return tidy(out, "sector_avgcorr_21d")


@register
def forward_rv(p: Panel) -> DataFrame:
    out = lb.forward_realized_vol(lb.log_returns(p.prices), Target())
    return tidy(out.select("asset", "trade_date", "rv_fwd"), "rv_fwd")


@register
def modeling_frame(p: Panel) -> DataFrame:
    return tidy(ft.modeling_frame(p.features, p.labels).drop("label_name"), *ft.ALL_FEATURES, "rv_fwd", "threshold")


MODEL_FEATURES = ft.BASE_FEATURES


@register
def design_matrix(p: Panel) -> DataFrame:
    out = ft.design_matrix(p.some_features(*MODEL_FEATURES), MODEL_FEATURES)
    return tidy(out, *MODEL_FEATURES)


# ---- data quality --------------------------------------------------------------------------------


def _wanted(p: Panel) -> DataFrame:
    """Requested tickers: the known assets and one that has no rows."""
    extra = p.assets.where(F.col("asset") == "A1").select(F.lit("A9").alias("asset"))
    return p.assets.select("asset").unionByName(extra)


def _today() -> Column:
    return F.lit("2001-12-31").cast("date")


def _series_dim(p: Panel) -> DataFrame:
    daily = p.daily.select("series", F.lit("daily").alias("frequency"), F.lit("rule_lag").alias("method"))
    monthly = p.monthly.select("series", F.lit("monthly").alias("frequency"), F.lit("alfred_vintage").alias("method"))
    known = daily.unionByName(monthly).distinct()
    absent = p.spark.createDataFrame([("D_NONE", "daily", "rule_lag")], known.schema)
    return known.unionByName(absent)


def _coarse(p: Panel) -> DataFrame:
    """Prices on a coarse tick, where identical consecutive closes do occur."""
    return p.prices.withColumn("close", F.floor(F.col("close") / 20_000) * 20_000.0 + 10_000.0)


def _refreshed(p: Panel) -> DataFrame:
    """A later pull: one trading volume in 97 comes with a restated close."""
    restated = F.when(F.col("volume") % 97 == 0, F.col("close") * 1.0001).otherwise(F.col("close"))
    return p.prices.withColumn("close", restated)


@register
def dq_basic(p: Panel) -> DataFrame:
    return dq.basic_checks(p.feed).unionByName(dq.no_rows(p.feed, _wanted(p)))


@register
def dq_calendar(p: Panel) -> DataFrame:
    return dq.calendar_checks(p.feed, p.calendar)


@register
def dq_outliers(p: Panel) -> DataFrame:
    return dq.outlier_checks(p.prices, p.assets)


@register
def dq_outliers_feed(p: Panel) -> DataFrame:
    """Same check on the raw feed, where one date repeats many times."""
    return dq.outlier_checks(p.feed, p.assets)


@register
def dq_stale(p: Panel) -> DataFrame:
    return dq.stale_checks(_coarse(p))


@register
def dq_drop_offcal(p: Panel) -> DataFrame:
    kept, report = dq.drop_off_calendar(p.prices, p.calendar)
    left = kept.groupBy(F.col("asset").alias("entity")).agg(F.count("*").alias("kept"))
    return left.join(report, "entity", "left")


@register
def dq_dropped_rows(p: Panel) -> DataFrame:
    """Every row that the load drops, with its close; ``dq_drop_offcal`` has counts and a sample of dates."""
    return dq.dropped_rows(p.prices, p.calendar)


@register
def dq_revision(p: Panel) -> DataFrame:
    return dq.revision_checks(p.prices, _refreshed(p))


@register
def dq_macro(p: Panel) -> DataFrame:
    return dq.macro_checks(p.daily.unionByName(p.monthly), _series_dim(p), _today())


@register
def dq_overlap(p: Panel) -> DataFrame:
    """March observations get a validity that runs into their revision."""
    longer = F.when(F.month("observation_date") == 3, F.date_add("valid_to", 5)).otherwise(F.col("valid_to"))
    held = F.when(F.col("valid_to") == F.lit(OPEN_END), F.col("valid_to")).otherwise(longer)
    return dq.overlapping_vintages(p.monthly.withColumn("valid_to", held)).select(
        "series", "observation_date", "valid_from", "covered_to"
    )


@register
def dq_constraints(p: Panel) -> DataFrame:
    parts = [
        dq.rule_violations(p.feed, dq.price_rules()),
        dq.rule_violations(p.labels, dq.label_rules()),
        dq.rule_violations(
            p.assets, dq.enum_rule("asset_type_known", "asset_type", ("index", "volatility_index", "etf", "equity"))
        ),
        dq.duplicate_keys(p.feed, "asset", "trade_date").agg(
            F.lit("price_key_unique").alias("rule"), F.count("*").alias("violations")
        ),
        dq.orphan_keys(p.feed, p.calendar, "trade_date").agg(
            F.lit("price_date_in_calendar").alias("rule"), F.sum("rows").alias("violations")
        ),
    ]
    return readers.union_frames(parts)


@register
def dq_results(p: Panel) -> DataFrame:
    """Audit rows of one load, with the entities that its failed checks block."""
    checks = readers.union_frames(
        [
            dq.basic_checks(p.prices),
            dq.calendar_checks(p.prices, p.calendar),
            dq.stale_checks(p.prices),
            dq.no_rows(p.prices, _wanted(p)),
        ]
    ).withColumn("sample", F.lit(""))
    return dq.stored_results(checks).join(dq.blocked_entities(checks), "entity", "left")


def _loaded(p: Panel) -> str:
    """Store of history up to 2000 after a refresh from 2000 on, in which one asset has inverted ranges."""
    root = scratch_folder(p.spark, "load")
    sinks.upsert_years(p.stored.where(F.year("trade_date") <= 2000), f"{root}/prices", ("asset", "trade_date"))
    inverted = (F.col("asset") == "A3") & (F.col("volume") % 5 == 0)
    high = F.when(inverted, F.col("low") * 0.5).otherwise(F.col("high"))
    pull = _refreshed(p).where(F.year("trade_date") >= 2000).withColumn("high", high)
    load.load_prices(p.spark, root, "refresh", pull, _wanted(p), p.assets, p.calendar)
    return root


@register
def gated_load(p: Panel) -> DataFrame:
    """Prices after the load: blocked assets as before, the others with the refreshed rows."""
    prices = p.spark.read.parquet(f"{_loaded(p)}/prices")
    return prices.select("asset", "trade_date", "open", "high", "low", "close", "volume")


@register
def gated_load_audit(p: Panel) -> DataFrame:
    """Every check of the load with its limit and share, and what blocked its asset."""
    root = _loaded(p)
    verdicts = p.spark.read.parquet(f"{root}/verdicts").select(F.col("asset").alias("entity"), "blocked_by")
    return p.spark.read.parquet(f"{root}/checks").drop("run_id").join(verdicts, "entity", "left")


@register
def gated_load_runs(p: Panel) -> DataFrame:
    """The ledger of the load."""
    return ledger.run_status(p.spark.read.parquet(f"{_loaded(p)}/runs")).drop("started_at", "finished_at")


@register
def run_ledger(p: Panel) -> DataFrame:
    """Runs read from the events table: a start and, except for errors in flight, a finish."""
    events = panel.table(p.spark, p.sf_dir, "events")
    runs = events.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("load_prices").alias("pipeline"),
        F.col("ts").alias("event_ts"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "succeeded")
        .otherwise("running")
        .alias("status"),
        F.col("event_id").alias("rows_read"),
        F.col("event_id").alias("rows_written"),
        F.lit(None).cast("string").alias("error"),
    )
    status = ledger.run_status(runs)
    return (
        status.groupBy("pipeline", "status")
        .agg(
            F.count("*").alias("runs"),
            F.min(F.to_date("started_at")).alias("first_start"),
            F.max(F.to_date("finished_at")).alias("last_finish"),
        )
        .join(ledger.succeeded_runs(runs), "pipeline")
    )


@register
def frame_fingerprint(p: Panel) -> DataFrame:
    return ledger.fingerprint(p.labels)


@register
def snapshot_diff(p: Panel) -> DataFrame:
    year = F.year("trade_date")
    return ledger.snapshot_diff(
        p.prices.where(year <= 2000), _refreshed(p).where(year >= 1996), ["asset", "trade_date"]
    )


# ---- splits, predictions, metrics ----------------------------------------------------------------

# Declared closed-form scores: they stand in for fitted models where an exact SQL twin is wanted.


def _scores() -> dict[str, Column]:
    z1, z2, z3 = (F.log(F.col(c)) - 2.1 for c in ("rv_5d", "rv_21d", "rv_63d"))
    v, d = F.log(F.col("vix_level")) - 3.6, F.col("drawdown_252d")
    raw = {
        "har_logit": (-1.4 + 0.9 * z1 + 0.5 * z2 + 0.3 * z3, 6),
        "vix_logit": (-1.4 + 0.6 * v, 6),
        "garch_logit": (-1.4 + 1.2 * z1, 6),
        "logit_tuned": (-1.4 + 0.7 * z1 + 0.4 * v + 0.5 * d, 6),
        "hist_gb": (-1.5 + 1.0 * z2, 2),
        "random_forest": (-1.3 + 0.5 * z1 + 0.5 * z3 - 0.4 * d, 6),
    }
    return {m: F.round(1 / (1 + F.exp(-x)), digits) for m, (x, digits) in raw.items()}


# Models need every base feature; the closed-form scores need those that they read.
SCORE_FEATURES = (*ft.PRICE_FEATURES, "vix_level", "t10y2y_level")


def _eligible(p: Panel, names: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    frame = ft.modeling_frame(p.some_features(*names), p.labels)
    return splits.eligible_rows(frame, names, panel.MODELING_START, panel.HOLDOUT_START)


def _assigned(p: Panel, names: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    return splits.assign_folds(_eligible(p, names), panel.WALK_FORWARD)


def _predictions(p: Panel) -> DataFrame:
    """Every model scores the same test rows."""
    return _scored(_assigned(p, SCORE_FEATURES).where(F.col("role") == "test"))


def _scored(test: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("model"), s.alias("prob")) for m, s in _scores().items()])
    return test.select("fold", "asset", "as_of_date", "y", F.inline(each))


@register
def eligible_rows(p: Panel) -> DataFrame:
    return tidy(_eligible(p).select("asset", "as_of_date", "y", "label_known_date", "rv_21d"), "rv_21d")


@register
def purged_split(p: Panel) -> DataFrame:
    return _assigned(p).select("fold", "role", "asset", "as_of_date", "y")


@register
def fold_info(p: Panel) -> DataFrame:
    return splits.fold_info(_assigned(p))


@register
def holdout_split(p: Panel) -> DataFrame:
    """The holdout is the same split with later folds and the cut disabled."""
    frame = ft.modeling_frame(p.some_features(*MODEL_FEATURES), p.labels)
    rows = splits.eligible_rows(frame, MODEL_FEATURES, panel.MODELING_START, None)
    return splits.fold_info(splits.assign_folds(rows, panel.HOLDOUT))


@register
def inner_splits(p: Panel) -> DataFrame:
    return splits.inner_splits(_assigned(p, SCORE_FEATURES).where(F.col("role") == "train"))


@register
def prevalence(p: Panel) -> DataFrame:
    out = metrics_.prevalence_predictions(_assigned(p), ["asset", "as_of_date"])
    return tidy(out, "prob")


@register
def predictions(p: Panel) -> DataFrame:
    return _predictions(p)


@register
def metrics(p: Panel) -> DataFrame:
    names = ("prevalence", "brier", "log_loss", "roc_auc", "pr_auc", "ece")
    return tidy(metrics_.evaluate(_predictions(p)), *names)


@register
def metrics_long(p: Panel) -> DataFrame:
    return tidy(metrics_.metrics_long(metrics_.evaluate(_predictions(p))), "value")


@register
def roc_auc(p: Panel) -> DataFrame:
    counts = metrics_.score_counts(panel.classification(p.spark, p.sf_dir))
    return tidy(metrics_.ranking_metrics(counts).drop("pr_auc"), "roc_auc")


@register
def pr_auc(p: Panel) -> DataFrame:
    counts = metrics_.score_counts(panel.classification(p.spark, p.sf_dir))
    return tidy(metrics_.ranking_metrics(counts).drop("roc_auc"), "pr_auc")


@register
def calibration(p: Panel) -> DataFrame:
    table = metrics_.calibration_table(metrics_.score_counts(_predictions(p)))
    return tidy(table.withColumn("bin", F.col("bin").cast("bigint")), "mean_pred", "frac_pos")


@register
def ece(p: Panel) -> DataFrame:
    counts = metrics_.score_counts(panel.classification(p.spark, p.sf_dir))
    return tidy(metrics_.expected_calibration_error(metrics_.calibration_table(counts)), "ece")


@register
def fold_mean(p: Panel) -> DataFrame:
    out = metrics_.fold_means(metrics_.evaluate(_predictions(p)))
    return tidy(out, "pr_auc", "roc_auc", "brier", "log_loss", "ece")


@register
def prediction_outcome(p: Panel) -> DataFrame:
    """Predictions without outcomes, their version rows, and the labels they are judged by."""
    version = F.concat_ws("/", "model", "fold")
    preds = _predictions(p).select(version.alias("version"), "asset", "as_of_date", "prob")
    versions = _predictions(p).select(version.alias("version"), "model", "fold", F.lit(Target().label_name).alias("label_name")).distinct()
    out = metrics_.prediction_outcomes(preds, versions, p.labels)
    return tidy(out.where(F.col("y").isNotNull()).drop("threshold", "label_name"), "rv_fwd")


@register
def pairwise_pred(p: Panel) -> DataFrame:
    return inference.paired_predictions(_predictions(p), inference.PAIRS)


@register
def param_grid(p: Panel) -> DataFrame:
    """Tuning grids of the learners with the number of training rows each configuration meets."""
    grids = [
        splits.parameter_grid(p.spark, {"max_depth": (2, 3), "learning_rate": (0.03, 0.1)}).select(
            F.lit("hist_gb").alias("model"), "grid_pos", F.col("max_depth").alias("a"), F.col("learning_rate").alias("b")
        ),
        splits.parameter_grid(p.spark, {"max_depth": (4, 8), "min_leaf": (20, 50)}).select(
            F.lit("random_forest").alias("model"), "grid_pos", F.col("max_depth").alias("a"), F.col("min_leaf").alias("b")
        ),
    ]
    rows = splits.fold_info(_assigned(p)).select(F.lit(1).alias("one"), "fold", "n_train")
    both = readers.union_frames(grids).withColumn("one", F.lit(1))
    return both.join(rows, "one").drop("one")


@register
def cv_scores(p: Panel) -> DataFrame:
    return tidy(_cv_scores(p), "score")


@register
def best_config(p: Panel) -> DataFrame:
    return tidy(metrics_.best_configuration(_cv_scores(p)), "score")


def _cv_scores(p: Panel) -> DataFrame:
    """Inner log loss of three shrinkage settings of one score over each fold's validation years."""
    train = _assigned(p, SCORE_FEATURES).where(F.col("role") == "train").withColumn("year", F.year("as_of_date"))
    prob = _scores()["har_logit"]
    configs = F.array(
        *[
            F.struct(F.lit(i).alias("grid_pos"), F.lit(f"w={w}").alias("params"), (0.2 + w * (prob - 0.2)).alias("p"))
            for i, w in enumerate((0.25, 0.5, 1.0))
        ]
    )
    valid = train.join(splits.inner_splits(train), ["fold", "year"]).select("fold", "year", "y", F.inline(configs))
    losses = valid.groupBy("fold", "year", "grid_pos", "params").agg(
        F.avg(metrics_.log_loss(F.col("y"), F.col("p"))).alias("loss")
    )
    return metrics_.cv_scores(losses.withColumn("model", F.lit("har_shrunk")))


def _published(p: Panel) -> str:
    """Walk-forward results published twice; the first time with other probabilities for two models."""
    root = scratch_folder(p.spark, "evaluations")
    preds, trials = pin(_predictions(p)), pin(_cv_scores(p))
    info = pin(splits.fold_info(_assigned(p, SCORE_FEATURES)))
    label = Target().label_name
    first = preds.where(F.col("model").isin("har_logit", "hist_gb")).withColumn("prob", F.lit(0.5))
    for rows, stamp in ((first, "old"), (preds, "new")):
        evaluations.publish(root, rows, info, trials, "walk_forward", label, stamp)
    evaluations.frozen_hash(p.spark, root, "walk_forward", label, "new")
    return root


@register
def walk_forward_store(p: Panel) -> DataFrame:
    """All stored rows after two publications: one set per model, fold and kind."""
    root = _published(p)
    read = lambda name: evaluations.read(p.spark, root, name)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    parts = [
        read("version").select(
            F.lit("version").alias("kind"),
            "model",
            "fold",
            F.concat_ws("/", text("train_start"), text("train_end"), "data_hash").alias("name"),
            F.col("n_predictions").cast("double").alias("value"),
        ),
        read("prediction").select(
            F.lit("prediction").alias("kind"), "model", "fold", F.concat_ws("/", "asset", text("as_of_date")).alias("name"), F.col("prob").alias("value")
        ),
        read("metric").select(F.lit("metric").alias("kind"), "model", "fold", F.col("metric").alias("name"), "value"),
        read("trial").select(F.lit("trial").alias("kind"), "model", "fold", F.col("params").alias("name"), F.col("score").alias("value")),
    ]
    return tidy(readers.union_frames(parts), "value")


@register
def stored_outcomes(p: Panel) -> DataFrame:
    """Stored predictions with the outcomes of the labels; nothing is fitted or scored again."""
    found = evaluations.outcomes(p.spark, _published(p), p.labels, "walk_forward", Target().label_name)
    return tidy(found.select("model", "fold", "asset", "as_of_date", "prob", "y", "label_known_date", "rv_fwd"), "rv_fwd")


# ---- risk ----------------------------------------------------------------------------------------

# A fixed parameter set for recursion checks; percent returns of this panel are large.
GJR_FIXED = garch.GJR(omega=50.0, alpha=0.03, gamma=0.10, beta=0.85)
CONFS = RiskSettings().confidences


def _simple(p: Panel) -> DataFrame:
    return lb.simple_returns(p.stored)


def _portfolio(p: Panel) -> DataFrame:
    return risk.portfolio_returns(_simple(p), panel.PORTFOLIO)


def _with_portfolio(p: Panel) -> DataFrame:
    """Asset returns and the portfolio's as one more series, from one pass over the prices."""
    returns = _simple(p)
    return returns.unionByName(risk.portfolio_returns(returns, panel.PORTFOLIO))


def _fixed_rows(p: Panel) -> DataFrame:
    rows = _simple(p).where(F.col("r").isNotNull()).selectExpr("asset", "trade_date", "r * 100 AS x")
    h0 = rows.groupBy("asset").agg(F.expr("var_pop(x) AS h0"))
    return rows.join(h0, "asset").withColumns(GJR_FIXED.columns())


def _var_table(p: Panel, method: str) -> DataFrame:
    s = RiskSettings()
    returns = _with_portfolio(p)
    made = {
        "historical": lambda: risk.historical(returns, CONFS, s.window),
        "normal": lambda: risk.normal_ewma(returns, CONFS, s.ewma_lambda),
        "student": lambda: risk.student_t_ewma(returns, CONFS, s.ewma_lambda, s.student_t_df),
    }
    return tidy(made[method](), "var", "es")


@register
def ewma_vol(p: Panel) -> DataFrame:
    out = recursion.ewma_variance(_simple(p), RiskSettings().ewma_lambda)
    return tidy(out.selectExpr("asset", "trade_date", "sqrt(252 * ewma_var) AS ewma_vol"), "ewma_vol")


@register
def ewma_vol_gaps(p: Panel) -> DataFrame:
    """The same on series with gaps: every day from the 10th to the 14th of a month has no return."""
    gap = F.dayofmonth("trade_date").between(10, 14)
    returns = _simple(p).withColumn("r", F.when(~gap, F.col("r")))
    out = recursion.ewma_variance(returns, RiskSettings().ewma_lambda)
    return tidy(out.selectExpr("asset", "trade_date", "sqrt(252 * ewma_var) AS ewma_vol"), "ewma_vol")


@register
def var_historical(p: Panel) -> DataFrame:
    return _var_table(p, "historical")


@register
def var_normal(p: Panel) -> DataFrame:
    return _var_table(p, "normal")


@register
def var_student_t(p: Panel) -> DataFrame:
    return _var_table(p, "student")


@register
def hist_es(p: Panel) -> DataFrame:
    """Whole-history quantile and tail mean per asset."""
    rows = _simple(p).where(F.col("r").isNotNull())
    out = risk.tail_means(rows, ["asset"], "r", {"95": 0.05, "99": 0.01})
    return tidy(out, "q_95", "m_95", "q_99", "m_99")


@register
def garch_path(p: Panel) -> DataFrame:
    return tidy(garch.variance_path(_fixed_rows(p)).select("asset", "trade_date", "h"), "h", digits=4)


@register
def garch_forecast(p: Panel) -> DataFrame:
    path = garch.variance_path(_fixed_rows(p))
    out = path.select("asset", "trade_date", garch.average_forecast(5).alias("avg_var"))
    return tidy(out, "avg_var", digits=4)


@register
def garch_fit(p: Panel) -> DataFrame:
    """Fitted parameters per asset on its whole history."""
    arrays = garch.return_arrays(_with_portfolio(p)).repartition("asset")
    return tidy(garch.fit_gjr(arrays).drop("rets"), *garch.PARAMS, "nll", "h0", digits=6)


@register
def var_fhs(p: Panel) -> DataFrame:
    returns = _with_portfolio(p)
    fits = pin(risk.yearly_fits(returns, RiskSettings().min_fit_obs))
    return risk.filtered_historical(returns, fits, CONFS, RiskSettings().window)


def _fixed_fits(returns: DataFrame) -> DataFrame:
    """The fixed parameter set for every year that has enough returns before it."""
    h0 = returns.groupBy("asset").agg(F.expr("var_pop(r * 100) AS h0"))
    return risk.fit_years(returns, RiskSettings().min_fit_obs).join(h0, "asset").withColumns(GJR_FIXED.columns())


@register
def fhs_quantiles(p: Panel) -> DataFrame:
    """The simulation's tail step under fixed parameters, where an exact SQL twin exists."""
    returns = _simple(p)
    return tidy(risk.filtered_historical(returns, _fixed_fits(returns), CONFS, RiskSettings().window), "var", "es", digits=6)


@register
def var_estimates(p: Panel) -> DataFrame:
    """All four methods, the simulation with the fixed parameter set."""
    returns = _with_portfolio(p)
    return tidy(risk.all_estimates(returns, _fixed_fits(returns)), "var", "es")


@register
def mc_var(p: Panel) -> DataFrame:
    """Ten-day simulation per asset, 100,000 paths each, from the fixed parameter set."""
    s = RiskSettings()
    h0 = _simple(p).groupBy("asset").agg(F.expr("var_pop(r * 100) AS h0"))
    params = h0.withColumns(GJR_FIXED.columns())
    state = risk.simulation_state(_simple(p), params, s.window)
    return tidy(risk.monte_carlo(state, CONFS, s.mc_horizon, s.mc_paths, seed=0), "var", "es", digits=6)


def _exceptions(p: Panel) -> DataFrame:
    returns = _with_portfolio(p)
    return pin(risk.exceptions(returns, risk.all_estimates(returns, _fixed_fits(returns))))


@register
def var_backtest(p: Panel) -> DataFrame:
    out = risk.backtest_table(_exceptions(p))
    names = [c for c in out.columns if c not in ("asset", "method", "conf", "n", "exceptions")]
    return tidy(out, *names)


@register
def kupiec(p: Panel) -> DataFrame:
    counts = _exceptions(p).groupBy("asset", "method", "conf").agg(F.count("*").alias("n"), F.sum("exc").alias("x"))
    return tidy(counts.withColumn("lr", risk.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("conf"))), "lr")


@register
def christoffersen(p: Panel) -> DataFrame:
    counts = risk.transition_counts(_exceptions(p))
    lr = risk.christoffersen_lr(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11"))
    return tidy(counts.withColumn("lr", lr), "lr")


@register
def basel(p: Panel) -> DataFrame:
    """Traffic lights, which are defined for 99 % alone."""
    rows = _exceptions(p).where("abs(conf - 0.99) < 1e-9")
    return tidy(risk.basel_shares(rows), "basel_green", "basel_yellow", "basel_red")


@register
def portfolio_returns(p: Panel) -> DataFrame:
    return tidy(_portfolio(p), "r")


@register
def max_drawdown(p: Panel) -> DataFrame:
    rows = risk.with_drawdown(_with_portfolio(p).where(F.col("r").isNotNull()).withColumn("r", F.col("r") / 50), ["asset"])
    return tidy(rows.groupBy("asset").agg(risk.max_drawdown()), "max_drawdown")


@register
def betas(p: Panel) -> DataFrame:
    return tidy(risk.betas(_simple(p), list(panel.PORTFOLIO), panel.ROLES.market), "beta")


@register
def cov_matrix(p: Panel) -> DataFrame:
    """Of the four assets that its SQL declares; ``cov_matrix_all`` has the whole panel."""
    return tidy(risk.covariance_matrix(_simple(p), ["A1", "A2", "A3", "A4"]), "cov")


@register
def cov_matrix_all(p: Panel) -> DataFrame:
    """Of every asset of the panel, on the days that are complete over all of them."""
    return tidy(risk.covariance_blocks(_simple(p), p.assets.select("asset").distinct()), "cov")


@register
def shock_loss(p: Panel) -> DataFrame:
    """Beta-scaled market fall, and joint shocks of positions held in proportion to traded volume."""
    beta = risk.betas(_simple(p), list(panel.PORTFOLIO), panel.ROLES.market)
    equity = risk.equity_shock(beta, panel.PORTFOLIO, RiskSettings().equity_shock)
    volume = p.prices.groupBy("asset").agg(F.sum("volume").alias("v"))
    total = p.prices.select(F.sum("volume")).scalar()
    positions = volume.select("asset", (F.col("v") / total).alias("w"))
    joint = risk.joint_shock(positions, panel.JOINT_SHOCKS)
    return tidy(equity.select(F.lit("equity_shock").alias("scenario"), "loss").unionByName(joint), "loss")


@register
def stressed_var(p: Panel) -> DataFrame:
    s = RiskSettings()
    returns = _simple(p)
    base = risk.stressed_normal(returns, panel.PORTFOLIO, 0.99).withColumn("scenario", F.lit("baseline"))
    hard = risk.stressed_normal(returns, panel.PORTFOLIO, 0.99, s.vol_multiplier, s.correlation_blend)
    return tidy(base.unionByName(hard.withColumn("scenario", F.lit("stressed"))), "sigma", "var", "es")


@register
def stress_replay(p: Panel) -> DataFrame:
    rows = _with_portfolio(p).withColumn("r", F.col("r") / 50)
    return tidy(risk.replay(rows, panel.REPLAYS), "total_return", "max_drawdown", "worst_day")


@register
def portfolio_metrics(p: Panel) -> DataFrame:
    returns = _simple(p).withColumn("r", F.col("r") / 50)
    port = risk.portfolio_returns(returns, panel.PORTFOLIO)
    market = returns.where(F.col("asset") == panel.ROLES.market).selectExpr("trade_date", "r AS m")
    spine = port.select(F.lit("portfolio").alias("asset"), "trade_date")
    cash = pit.cash_rate(spine, p.daily, panel.ROLES.policy_rate).select("trade_date", "cash")
    out = risk.portfolio_metrics(port, market, cash)
    return tidy(out, *[c for c in out.columns if c != "asset"], digits=6)


# ---- overlay -------------------------------------------------------------------------------------

OVERLAY_MODELS = ("random_forest", "logit_tuned")
BT_START, BT_END = panel.WALK_FORWARD[0].test_start, panel.WALK_FORWARD[-1].test_end
SHARPE_PAIRS = tuple(
    (f"model_{m}", f"model_{m}", b) for m in OVERLAY_MODELS for b in ("buy_hold", "ewma_vol_target", "vix_target")
)


def _overlay_inputs(p: Panel, predictions: DataFrame | None = None) -> DataFrame:
    """Returns are scaled to a daily size on this panel of independent prices."""
    returns = _simple(p).withColumn("r", F.col("r") / 50)
    implied = p.stored.where(F.col("asset") == panel.ROLES.implied_vol).selectExpr("trade_date", f"close / {panel.IMPLIED_SCALE}D AS vix")
    cash = pit.cash_rate(p.stored, p.daily, panel.ROLES.policy_rate)
    predictions = _predictions(p) if predictions is None else predictions
    return overlay.market_inputs(returns, implied, cash, predictions, OVERLAY_MODELS, OverlaySettings().ewma_lambda)


def _weights(p: Panel) -> DataFrame:
    s = OverlaySettings()
    return overlay.build_weights(_overlay_inputs(p), OVERLAY_MODELS, s.target_vol, s.max_weight)


def _backtest(p: Panel) -> DataFrame:
    s = OverlaySettings()
    return overlay.run_backtest(_weights(p), OVERLAY_MODELS, s.lag, s.cost_bps, BT_START, BT_END, "model_random_forest")


@register
def overlay_weights(p: Panel) -> DataFrame:
    names = ["w_buy_hold", "w_ewma_vol_target", "w_vix_target", *[f"w_model_{m}" for m in OVERLAY_MODELS]]
    return tidy(_weights(p).select("asset", "trade_date", *names), *names)


@register
def overlay_returns(p: Panel) -> DataFrame:
    return tidy(_backtest(p).drop("cash"), "held", "turnover", "net")


@register
def performance(p: Panel) -> DataFrame:
    out = overlay.performance(pin(_backtest(p)))
    return tidy(out, *[c for c in out.columns if c not in ("asset", "strategy", "days")], digits=6)


@register
def episode_table(p: Panel) -> DataFrame:
    out = overlay.episode_table(_backtest(p), panel.EPISODES)
    return tidy(out, *[c for c in out.columns if c not in ("asset", "strategy")])


@register
def overlay_sensitivity(p: Panel) -> DataFrame:
    out = overlay.sensitivity(_overlay_inputs(p), OVERLAY_MODELS, BT_START, BT_END, "model_random_forest")
    return tidy(out, "sharpe", digits=6)


# ---- forecast comparison -------------------------------------------------------------------------


@register
def dm_test(p: Panel) -> DataFrame:
    paired = inference.paired_predictions(_predictions(p), inference.PAIRS)
    keys = ["asset", "family", "model", "vs"]
    out = inference.dm_test(inference.loss_differences(paired), keys, ["fold", "as_of_date"], InferenceSettings().dm_horizon)
    return tidy(out.drop("p_dm"), "mean_diff", "stat", digits=6)


@register
def dm_p_values(p: Panel) -> DataFrame:
    """Two-sided Student-t p-values of the loss differences."""
    paired = inference.paired_predictions(_predictions(p), inference.PAIRS)
    keys = ["asset", "family", "model", "vs"]
    out = inference.dm_test(inference.loss_differences(paired), keys, ["fold", "as_of_date"], InferenceSettings().dm_horizon)
    return tidy(out.select(*keys, "p_dm"), "p_dm", digits=6)


@register
def holm(p: Panel) -> DataFrame:
    """Step-down adjustment of the shares of days on which each model loses to its benchmark."""
    paired = inference.loss_differences(inference.paired_predictions(_predictions(p), inference.PAIRS))
    shares = paired.groupBy("asset", "family", "model", "vs").agg(F.expr("avg(cast(d > 0 AS double)) / 20 AS p"))
    return tidy(inference.holm(shares, ["asset", "family"], "p", "p_holm"), "p", "p_holm")


def _day_counts(p: Panel) -> DataFrame:
    days = _predictions(p).where(F.col("model") == "har_logit")
    return days.groupBy("asset", "fold").agg(F.count("*").cast("int").alias("n"))


@register
def bootstrap_index(p: Panel) -> DataFrame:
    """How often each position is drawn over all draws of every asset's fold."""
    s = InferenceSettings()
    index = inference.bootstrap_index(_day_counts(p), s.draws, s.seed, s.mean_block)
    return index.groupBy("asset", "fold", "idx").agg(F.count("*").alias("times"), F.sum("pos").alias("pos_sum"))


@register
def bootstrap_sharpe(p: Panel) -> DataFrame:
    out = inference.sharpe_tests(overlay.excess_returns(_backtest(p)), SHARPE_PAIRS, InferenceSettings())
    return tidy(out.drop("p_boot_holm"), "sharpe_diff", "ci_low", "ci_high", "p_boot", digits=6)


@register
def sharpe_tests(p: Panel) -> DataFrame:
    out = inference.sharpe_tests(overlay.excess_returns(pin(_backtest(p))), SHARPE_PAIRS, InferenceSettings())
    return tidy(out, "sharpe_diff", "ci_low", "ci_high", "p_boot", "p_boot_holm", digits=6)


@register
def bootstrap_pr_auc(p: Panel) -> DataFrame:
    out = inference.pr_auc_tests(_predictions(p), inference.PAIRS, InferenceSettings())
    return tidy(out, "pr_auc_diff", "ci_low", "ci_high", "p_boot", digits=6)


@register
def pairwise_tests(p: Panel) -> DataFrame:
    out = inference.pairwise_tests(pin(_predictions(p)), inference.PAIRS, InferenceSettings())
    return tidy(out, *[c for c in out.columns if c not in ("asset", "family", "model", "vs")], digits=6)


# ---- fitted models -------------------------------------------------------------------------------


def _fit_rows(p: Panel) -> DataFrame:
    return pin(_eligible(p))


def _fitted(p: Panel, specs: list[models.Spec], folds: list[Fold]) -> DataFrame:
    return models.walk_forward(_fit_rows(p), specs, folds)[0]


@register
def logit_ladder(p: Panel) -> DataFrame:
    """The four fixed logits on every fold."""
    return _fitted(p, models.ladder(MODEL_FEATURES), panel.WALK_FORWARD)


@register
def garch_logit(p: Panel) -> DataFrame:
    return models.variance_logit(_fit_rows(p), _simple(p), panel.WALK_FORWARD)


@register
def logit_tuned(p: Panel) -> DataFrame:
    return _fitted(p, models.learners(MODEL_FEATURES)[:1], panel.WALK_FORWARD)


@register
def gbt_tuned(p: Panel) -> DataFrame:
    """Boosting with the declared grid, on every fold."""
    return models.boosted_walk_forward(_fit_rows(p), panel.WALK_FORWARD, MODEL_FEATURES)[0]


@register
def logit_trials(p: Panel) -> DataFrame:
    """Every setting of the tuned logit with its mean inner log loss, from real fits."""
    return models.tuning_scores(_fit_rows(p), models.learners(MODEL_FEATURES)[0], panel.WALK_FORWARD)


@register
def rf_tuned(p: Panel) -> DataFrame:
    """Forest with the declared grid, on every fold."""
    return _fitted(p, models.learners(MODEL_FEATURES)[2:], panel.WALK_FORWARD)


@register
def walk_forward(p: Panel) -> DataFrame:
    """Fitted ladder and prevalence, evaluated per fold and pooled."""
    rows = _fit_rows(p)
    fitted, _ = models.walk_forward(rows, models.ladder(MODEL_FEATURES), panel.WALK_FORWARD)
    constant = metrics_.prevalence_predictions(splits.assign_folds(rows, panel.WALK_FORWARD), ["asset", "as_of_date"])
    return metrics_.evaluate(fitted.unionByName(constant))


# ---- holdout -------------------------------------------------------------------------------------


def _in_holdout(day: str) -> Column:
    return F.col(day).between(F.lit(panel.HOLDOUT[0].test_start), F.lit(panel.HOLDOUT[-1].test_end))


@register
def holdout_risk(p: Panel) -> DataFrame:
    """The VaR backtest over the holdout alone; estimates look back into the years before it."""
    out = risk.backtest_table(_exceptions(p).where(_in_holdout("trade_date")))
    return tidy(out, *[c for c in out.columns if c not in ("asset", "method", "conf", "n", "exceptions")])


def _holdout_backtest(p: Panel) -> DataFrame:
    frame = ft.modeling_frame(p.some_features(*SCORE_FEATURES), p.labels)
    rows = splits.eligible_rows(frame, SCORE_FEATURES, panel.MODELING_START, None)
    test = splits.assign_folds(rows, panel.HOLDOUT).where(F.col("role") == "test")
    s = OverlaySettings()
    weights = overlay.build_weights(_overlay_inputs(p, _scored(test)), OVERLAY_MODELS, s.target_vol, s.max_weight)
    start, end = panel.HOLDOUT[0].test_start, panel.HOLDOUT[-1].test_end
    return overlay.run_backtest(weights, OVERLAY_MODELS, s.lag, s.cost_bps, start, end, "model_random_forest")


@register
def holdout_overlay(p: Panel) -> DataFrame:
    """The overlay over the holdout, on predictions of its own fold."""
    return tidy(_holdout_backtest(p).drop("cash"), "held", "turnover", "net")


# ---- counts and declared rules -------------------------------------------------------------------


@register
def trial_counts(p: Panel) -> DataFrame:
    """Models, distinct configurations and trials behind the scores."""
    return _cv_scores(p).agg(
        F.countDistinct("model").alias("models"),
        F.countDistinct("model", "params").alias("configurations"),
        F.count("*").alias("trials"),
        F.sum("splits").alias("fits"),
    )


def _fold_losses(p: Panel) -> DataFrame:
    """Brier score of every model per fold, with the best ones marked as champions."""
    scores = _predictions(p).groupBy("fold", "model").agg(F.round(F.avg(F.pow(F.col("prob") - F.col("y"), 2)), 10).alias("brier"))
    best = F.min("brier").over(Window.partitionBy("fold"))
    return scores.withColumn("champion", F.col("brier") == best)


@register
def dq_model_rules(p: Panel) -> DataFrame:
    """Rules on predictions, feature values, intervals and the one champion of a fold."""
    losses = _fold_losses(p)
    several = dq.filtered_duplicates(losses, F.col("champion"), "fold").agg(F.lit("one_champion").alias("rule"), F.count("*").alias("violations"))
    missing = dq.filtered_absent(losses, F.col("champion"), "fold").agg(F.lit("some_champion").alias("rule"), F.count("*").alias("violations"))
    long = sinks.long_values(p.features, ["asset", "as_of_date"], ft.ALL_FEATURES)
    parts = [
        dq.rule_violations(_predictions(p), dq.prediction_rules()),
        dq.rule_violations(long, dq.finite_rule()),
        dq.rule_violations(p.monthly, dq.interval_rule("vintage_interval_ordered", "valid_from", "valid_to")),
        several,
        missing,
    ]
    return readers.union_frames(parts)


@register
def scan_wanted(p: Panel) -> DataFrame:
    """Prices of wanted assets, and a row without prices for each wanted one that the table lacks."""
    wanted = ["A1", "A3", "ZZ", "A9"]
    found = readers.scan_prices(p.prices, p.assets, wanted).select("asset", "trade_date", "close")
    lost = readers.missing_tickers(found, p.spark.createDataFrame([(w,) for w in wanted], "asset string"))
    return found.unionByName(lost.select("asset", F.lit(None).cast("date").alias("trade_date"), F.lit(None).cast("double").alias("close")))
