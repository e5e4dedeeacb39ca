"""A load writes only what its gate lets through, and leaves the same store when it is run again."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from panelvar.operators import load
from panelvar.sources import sinks

from .conftest import price_frame


@pytest.fixture(scope="module")
def frames():
    out = {}
    for i, name in enumerate(("A", "B", "C")):
        frame = price_frame(name, 560, seed=i, start="2019-01-01")
        frame["open"] = frame["close"]
        out[name] = frame
    return out


@pytest.fixture(scope="module")
def dims(spark, frames):
    cal = spark.createDataFrame([(d,) for d in frames["A"].trade_date], "trade_date date")
    assets = spark.createDataFrame([(a, "etf") for a in "ABCD"], "asset string, asset_type string")
    wanted = spark.createDataFrame([(a,) for a in "ABDX"], "asset string")
    return cal, assets, wanted


def rows(df) -> list:
    return sorted(tuple(r) for r in df.select("asset", "trade_date", "close", "high").collect())


def test_blocked_assets_stay_and_others_change(spark, frames, dims, tmp_path):
    cal, assets, wanted = dims
    root = str(tmp_path)
    seed = spark.createDataFrame(pd.concat([frames[a] for a in "ABC"]))
    sinks.upsert_years(seed, f"{root}/prices", ("asset", "trade_date"))
    late = {a: frames[a][frames[a].trade_date.map(lambda d: d.year == 2020)].copy() for a in "ABC"}
    late["A"]["close"] *= 1.001
    late["B"].loc[late["B"].index[3], "high"] = 0.5 * late["B"].low.iloc[3]  # blocks B
    late["C"]["close"] *= 2  # not asked for
    pull = spark.createDataFrame(pd.concat(late.values()))
    files = {f for f in os.listdir(f"{root}/prices/year=2019")}
    before = rows(spark.read.parquet(f"{root}/prices").where("asset <> 'A' OR year <> 2020"))
    for _ in range(2):  # the second run under the same id finds its own work done
        assert load.load_prices(spark, root, "r1", pull, wanted, assets, cal) is False
        store = spark.read.parquet(f"{root}/prices")
        assert store.count() == seed.count()
        assert rows(store.where("asset <> 'A' OR year <> 2020")) == before
        assert rows(store.where("asset = 'A' AND year = 2020")) == sorted(
            (r.asset, r.trade_date, r.close, r.high) for r in late["A"].itertuples()
        )
        verdicts = {r.asset: r.blocked_by for r in spark.read.parquet(f"{root}/verdicts").collect()}
        assert verdicts == {"A": None, "B": "high_below_low", "D": "no_rows", "X": "unknown_asset"}
        assert spark.read.parquet(f"{root}/pulls").count() == pull.count()
    assert {f for f in os.listdir(f"{root}/prices/year=2019")} == files  # untouched years are not rewritten
    runs = spark.read.parquet(f"{root}/runs").where("status = 'failed'").collect()
    assert [(r.rows_read, r.rows_written, r.error) for r in runs] == [(pull.count(), len(late["A"]), "3 assets blocked")] * 2


def test_first_load_and_an_empty_pull(spark, frames, dims, tmp_path):
    cal, assets, _ = dims
    root = str(tmp_path)
    wanted = spark.createDataFrame([("A",)], "asset string")
    pull = spark.createDataFrame(frames["A"])
    assert load.load_prices(spark, root, "r1", pull, wanted, assets, cal) is True
    store = rows(spark.read.parquet(f"{root}/prices"))
    assert len(store) == len(frames["A"])
    assert load.load_prices(spark, root, "r2", pull.limit(0), wanted, assets, cal) is False
    assert rows(spark.read.parquet(f"{root}/prices")) == store
    status = {r.run_id: r.status for r in spark.read.parquet(f"{root}/runs").where("status <> 'running'").collect()}
    assert status == {"r1": "succeeded", "r2": "failed"}


def test_an_error_closes_the_run_as_failed(spark, frames, dims, tmp_path):
    cal, assets, wanted = dims
    pull = spark.createDataFrame(frames["A"]).drop("volume")
    with pytest.raises(Exception):
        load.load_prices(spark, str(tmp_path), "r1", pull, wanted, assets, cal)
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert sorted(r.status for r in runs.collect()) == ["failed", "running"]


def test_checks_carry_limit_and_share(spark, frames, dims):
    cal, assets, wanted = dims
    frame = frames["A"].copy()
    frame.loc[frame.index[[5, 6]], "high"] = 1.0
    result = load.gate(spark.createDataFrame(frame), wanted, assets, cal, spark.createDataFrame(frames["A"]))
    got = {(r.entity, r.check_name): r for r in result.checks.collect()}
    hit = got["A", "close_outside_range"]
    assert (hit.n, hit.rows_judged, hit.fraction, hit.limit) == (2, len(frame), 2 / len(frame), 1e-6)
    assert got["X", "unknown_asset"].fraction is None and result.accepted.count() == 0


def test_no_task_runs_all_checks(spark, frames, dims, monkeypatch):
    cal, assets, wanted = dims
    pinned, plain = [], load.pin
    monkeypatch.setattr(load, "pin", lambda df: pinned.append(df) or plain(df))
    load.gate(spark.createDataFrame(frames["A"]), wanted, assets, cal, spark.createDataFrame(frames["A"]))
    (checks,) = [df for df in pinned if "limit" in df.columns]
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Window" not in plan
