"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelvar.plans.registry import QUERIES  # noqa: E402
from panelvar.session import build_session  # noqa: E402

HEADLINE = (
    "scan_prices",
    "raw_pull_hash",
    "upsert_prices",
    "dq_basic",
    "dq_calendar",
    "label_prevalence",
    "features_core",
    "features_long",
    "pit_latest",
    "asof_daily",
    "purged_split",
    "metrics",
    "var_historical",
    "var_normal",
    "var_backtest",
    "mc_var",
    "garch_fit",
    "overlay_returns",
    "performance",
    "bootstrap_sharpe",
    "bootstrap_pr_auc",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app="panelvar-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's code paths and the Python workers.
    QUERIES["var_historical"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
