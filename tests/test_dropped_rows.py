"""Rows dropped from a load are recorded in full."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from panelvar.operators import quality as dq

from .conftest import price_frame


def test_every_dropped_row_is_recorded(spark):
    base = price_frame("A", 300, start="2020-01-01")
    cal = spark.createDataFrame([(d,) for d in base.trade_date], "trade_date date")
    saturdays = [dt.date(2020, 1, 4) + dt.timedelta(7 * k) for k in range(14)]
    extra = base.iloc[:14].assign(trade_date=saturdays, close=[100.0 + k for k in range(14)])
    extra = pd.concat([extra, extra.iloc[[3]]])  # a repeated row counts twice
    many = price_frame("B", 300, start="2020-01-01")
    above = many.iloc[:200].assign(trade_date=[dt.date(2020, 1, 4) + dt.timedelta(7 * (k % 50)) for k in range(200)])
    feed = spark.createDataFrame(pd.concat([base, extra, many, above]))
    rules = dq.QualityRules(max_off_calendar=0.1)
    kept, report = dq.drop_off_calendar(feed, cal, rules)
    got = sorted((r.asset, r.trade_date, r.close) for r in dq.dropped_rows(feed, cal, rules).collect())
    assert got == sorted(("A", d, c) for d, c in zip(extra.trade_date, extra.close)) and len(got) == 15
    assert kept.count() == feed.count() - len(got) and [(r.entity, r.n) for r in report.collect()] == [("A", 15)]
