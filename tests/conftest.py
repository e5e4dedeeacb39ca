from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelvar.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        app="panelvar-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def price_frame(asset: str, days: int = 420, seed: int = 0, start: str = "2015-01-01") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, days)))
    dates = pd.bdate_range(start, periods=days).date
    return pd.DataFrame(
        {
            "asset": asset,
            "trade_date": dates,
            "open": close * np.exp(rng.normal(0, 0.003, days)),
            "high": close * 1.01,
            "low": close * 0.99,
            "close": close,
            "adj_close": close,
            "volume": rng.integers(1_000, 5_000, days),
        }
    )


@pytest.fixture(scope="session")
def panel_frame() -> pd.DataFrame:
    return pd.concat([price_frame(f"X{i}", seed=i) for i in range(1, 8)], ignore_index=True)
