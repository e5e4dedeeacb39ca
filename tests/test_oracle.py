"""A sample of the registered queries next to their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_oracle import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("label_prevalence", "first_trade_date", "dq_basic", "rule_lag", "pit_lagged", "var_normal", "cov_matrix", "roc_auc")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry_points.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and canonical(got) == canonical(want)


def test_entry_and_registration(spark):
    assert entry_points.entry(spark).count() == 7
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
