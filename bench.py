"""Headline queries on one machine: one warm-up of all, then the median of three runs each.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Results go to a sink that drops
them, so only the queries count. Prints one line of JSON.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from adlens.session import build_session
from workload.queries import queries

HEADLINE = (
    "optimize_simulate", "optimize", "simulate", "scenario_totals_direct", "fit_curves",
    "fit_curves_many_series", "rolling_lag", "featured_long_history", "clean_facts",
    "cleaning_audit", "forecast_flat", "forecast_forest", "forecast_summary",
    "daily_actual_vs_forecast", "channel_rank", "narrative", "answer_messages", "report_blocks",
    "catalog_latest", "synth_campaigns",
)
RUNS = 3


def seconds(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "adlens-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    for name in names:
        seconds(known[name], spark, folder)
    timings = {}
    for name in names:
        runs = [seconds(known[name], spark, folder) for _ in range(RUNS)]
        timings[name] = round(statistics.median(runs), 3)
    scale = re.search(r"sf([\d.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
