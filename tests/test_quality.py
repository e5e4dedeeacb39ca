from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelvar.operators import ledger
from panelvar.operators import quality as dq
from panelvar.settings import QualityRules
from panelvar.sources import readers, sinks

from .conftest import price_frame


def failed(df) -> set[str]:
    return {r.check_name for r in df.collect() if not r.passed}


@pytest.fixture(scope="module")
def base() -> pd.DataFrame:
    frame = price_frame("A", 300, start="2020-01-01")
    frame["open"] = frame["close"]
    return frame


def calendar(spark, frame):
    return spark.createDataFrame([(d,) for d in frame.trade_date], "trade_date date")


def every_check(spark, frame, cal, kind="etf"):
    assets = spark.createDataFrame([("A", kind)], "asset string, asset_type string")
    df = spark.createDataFrame(frame)
    return dq.basic_checks(df).unionByName(dq.calendar_checks(df, cal)).unionByName(
        dq.outlier_checks(df, assets)
    ).unionByName(dq.stale_checks(df))


def test_clean_frame_passes(spark, base):
    assert failed(every_check(spark, base, calendar(spark, base))) == set()


def mutate(frame, kind):
    f = frame.copy()
    if kind == "duplicate_dates":
        f = pd.concat([f, f.iloc[[10]]])
    elif kind == "high_below_low":
        f.loc[5, ["high", "low"]] = [f.close[5] * 0.9, f.close[5] * 1.1]
    elif kind == "null_close":
        f.loc[7, "close"] = np.nan
    elif kind == "non_positive_price":
        f.loc[9, "open"] = 0.0
    elif kind == "close_outside_range":
        f.loc[3, "close"] = f.high[3] * 1.02
    elif kind == "return_outliers":
        f.loc[100:, ["open", "high", "low", "close"]] *= 0.7
    elif kind == "stale_prices":
        f.loc[20:25, ["open", "high", "low", "close"]] = [50.0, 50.5, 49.5, 50.0]
        f.loc[26:, ["open", "high", "low", "close"]] *= 50 / f.close[19]
        f.loc[:19, ["open", "high", "low", "close"]] *= 50 / f.close[19]
    return f


@pytest.mark.parametrize(
    "kind", ["duplicate_dates", "high_below_low", "non_positive_price", "close_outside_range", "return_outliers", "stale_prices"]
)
def test_one_mutation_trips_its_check(spark, base, kind):
    got = failed(every_check(spark, mutate(base, kind), calendar(spark, base)))
    assert kind in got and got <= {kind, "close_outside_range"}


def test_null_close_and_volatility_index(spark, base):
    frame = mutate(base, "null_close")
    df = spark.createDataFrame(frame).selectExpr("*").na.replace(float("nan"), None)
    rows = {r.check_name: r.n for r in dq.basic_checks(df).collect()}
    assert rows["null_close"] == 1
    assert "return_outliers" not in failed(every_check(spark, mutate(base, "return_outliers"), calendar(spark, base), "volatility_index"))


def test_missing_and_extra_days(spark, base):
    cal = calendar(spark, base)
    for gone, level in ((1, "warn"), (12, "error")):
        kept = base.drop(index=range(50, 50 + gone))
        row = [r for r in dq.calendar_checks(spark.createDataFrame(kept), cal).collect() if r.check_name == "missing_trading_days"][0]
        assert (row.n, row.severity, row.passed) == (gone, level, False)
        assert row.sample.split(",")[0] == str(base.trade_date[50])
    off = base.copy()
    off.loc[0, "trade_date"] = dt.date(2019, 12, 28)
    assert "non_trading_dates" in failed(dq.calendar_checks(spark.createDataFrame(off), cal))


def test_run_across_months_and_repeated_dates(spark):
    days = pd.date_range("2020-01-28", periods=8).date
    rows = [("A", d, 10.0) for d in days] + [("A", days[3], 10.0), ("A", days[-1] + dt.timedelta(1), 11.0)]
    df = spark.createDataFrame(rows, "asset string, trade_date date, close double")
    row = dq.stale_checks(df).first()
    assert row.n == 9 and not row.passed


def test_off_calendar_rows(spark, base):
    cal = calendar(spark, base)
    big = pd.concat([base] * 1)
    extra = base.iloc[[100]].assign(trade_date=dt.date(2020, 5, 23))
    rules = dq.QualityRules(max_off_calendar=0.01)
    kept, report = dq.drop_off_calendar(spark.createDataFrame(pd.concat([big, extra])), cal, rules)
    assert kept.count() == len(base) and failed(report) == {"non_trading_rows_dropped"}
    kept, report = dq.drop_off_calendar(spark.createDataFrame(pd.concat([big, extra])), cal)
    assert kept.count() == len(base) + 1 and report.count() == 0
    short = spark.createDataFrame([(d,) for d in base.trade_date[:-10]], "trade_date date")
    kept, report = dq.drop_off_calendar(spark.createDataFrame(base), short, rules)
    assert kept.count() == len(base) and [(r.check_name, r.n) for r in report.collect()] == [("calendar_stale", 10)]


def test_no_rows_revision_and_blocking(spark, base):
    df = spark.createDataFrame(base)
    wanted = spark.createDataFrame([("A",), ("B",)], "asset string")
    checks = dq.no_rows(df, wanted).unionByName(dq.basic_checks(df))
    assert [(r.entity, r.blocked_by) for r in dq.blocked_entities(checks).collect()] == [("B", "no_rows")]
    stored = {(r.entity, r.check_name): r.severity for r in dq.stored_results(checks).collect()}
    assert stored["B", "no_rows"] == "error" and stored["A", "null_close"] == "info"
    moved = base.copy()
    moved.loc[4, "close"] *= 1.001
    row = dq.revision_checks(df, spark.createDataFrame(moved)).first()
    assert (row.n, row.sample) == (1, str(base.trade_date[4]))
    assert dq.revision_checks(df.limit(0), df).first().passed


def test_macro_and_overlap(spark):
    rows = [
        ("M", "2020-01-01", "2020-02-05", "2020-04-29", 1.0),
        ("M", "2020-01-01", "2020-04-30", "9999-12-31", 1.1),
        ("M", "2020-02-01", "2020-02-05", "9999-12-31", 2.0),
        ("M", "2020-02-01", "2020-03-05", "9999-12-31", 2.5),
    ]
    v = spark.createDataFrame(rows, "series string, o string, f string, t string, value double").selectExpr(
        "series", "date(o) AS observation_date", "date(f) AS valid_from", "date(t) AS valid_to", "value"
    )
    dim = spark.createDataFrame([("M", "monthly", "alfred_vintage")], "series string, frequency string, method string")
    got = {r.check_name: (r.passed, r.n) for r in dq.macro_checks(v, dim, dq.F.lit("2020-03-15").cast("date")).collect()}
    assert got == {"first_vintage_lag": (False, 1), "staleness": (True, 43)}
    assert [str(r.valid_from) for r in dq.overlapping_vintages(v).collect()] == ["2020-03-05"]


def test_ingest_and_sinks(spark, base, tmp_path):
    payload = '{"series": "S", "observations": [{"date": "2020-01-01", "realtime_start": "2020-02-01", "realtime_end": "9999-12-31", "value": "1.5"}, {"date": "2020-02-01", "realtime_start": "2020-03-01", "realtime_end": "9999-12-31", "value": "."}]}'
    (tmp_path / "o.json").write_text(payload)
    rows = readers.read_observations(spark, str(tmp_path / "o.json")).collect()
    assert [(str(r.observation_date), str(r.valid_to), r.value) for r in rows] == [("2020-01-01", "9999-12-31", 1.5)]
    df = spark.createDataFrame(base)
    newer = df.where("trade_date > date'2021-01-01'").withColumn("close", df.close + 1)
    merged = sinks.latest_wins(df, newer, ["asset", "trade_date"])
    assert merged.count() == len(base)
    old = {r.trade_date: r.close for r in df.collect()}
    raised = merged.collect()
    late = dt.date(2021, 1, 1)
    assert all(r.close == old[r.trade_date] + (1 if r.trade_date > late else 0) for r in raised)
    path = str(tmp_path / "prices")
    sinks.write_partitions(df, path, "asset")
    sinks.write_partitions(df.withColumn("asset", dq.F.lit("B")), path, "asset")
    sinks.write_partitions(df.limit(5).withColumn("asset", dq.F.lit("B")), path, "asset")
    back = spark.read.parquet(path)
    assert {r.asset: r["count"] for r in back.groupBy("asset").count().collect()} == {"A": len(base), "B": 5}
    audit = sinks.raw_pull_audit(df).first()
    again = sinks.raw_pull_audit(df.orderBy(dq.F.desc("trade_date"))).first()
    assert audit.row_count == len(base) and audit.payload_hash == again.payload_hash
    changed = sinks.raw_pull_audit(df.withColumn("volume", df.volume + 1)).first()
    assert changed.payload_hash != audit.payload_hash


def test_ledger_fingerprint_and_diff(spark, base):
    events = ledger.run_event(spark, "r1", "load", "running").unionByName(
        ledger.run_event(spark, "r1", "load", "succeeded", 10, 9)
    )
    assert ledger.run_status(events).first().rows_written == 9
    df = spark.createDataFrame(base)
    assert ledger.fingerprint(df).first() == ledger.fingerprint(df.repartition(7)).first()
    other = df.where("trade_date <> date'2020-01-02'").withColumn(
        "close", dq.F.expr("CASE WHEN trade_date = date'2020-01-03' THEN 1.0 ELSE close END")
    )
    diff = {str(r.trade_date): r.change for r in ledger.snapshot_diff(df, other, ["asset", "trade_date"]).collect()}
    assert diff == {"2020-01-02": "removed", "2020-01-03": "modified"}


def test_outliers_of_a_feed_reduce_before_they_meet_the_dimension(spark):
    """Rows joined by asset would put a feed of few assets into few tasks; the day blocks follow the sorted closes."""
    rng = np.random.default_rng(5)
    days = [pd.Timestamp("2020-01-30") + pd.Timedelta(days=k) for k in range(8)]
    raw = [(a, d.date(), float(c)) for a in ("A", "V") for d in days for c in rng.choice([50.0, 60.0, 90.0, 95.0], 6)]
    raw += [("A", days[3].date(), None), ("A", pd.Timestamp("2020-03-02").date(), None), ("A", pd.Timestamp("2020-03-03").date(), 10.0)]
    feed = spark.createDataFrame(raw, "asset string, trade_date date, close double")
    assets = spark.createDataFrame([("A", "etf"), ("V", "volatility_index")], "asset string, asset_type string")
    out = dq.outlier_checks(feed, assets, QualityRules(outlier=0.3))
    closes = sorted(((d, c) for a, d, c in raw if a == "A"), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    moved = [d for (_, p), (d, c) in zip(closes, closes[1:]) if p and c and abs(np.log(c / p)) > 0.3]
    (got,) = out.collect()
    assert (got.entity, got.n) == ("A", len(moved)) and got.sample == ",".join(sorted({str(d) for d in moved})[:10])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Window") and "month(" not in plan
    assert "close" not in "".join(line.split("[", 2)[1] for line in plan.splitlines() if "Aggregate [" in line)  # no near-unique keys in a map
