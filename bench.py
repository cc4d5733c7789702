"""Time the registered queries: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 4), ``BENCH_QUERIES``
(comma-separated names; default: the headline set).
"""

from __future__ import annotations

import json
import os
import pathlib
import time

from barcast.plans.queries import registered
from barcast.session import local_session

HEADLINE = [
    "asset_summary",
    "dedupe_last",
    "regular_bars",
    "offgrid_rows",
    "lags_full",
    "supervised_rows",
    "class_balance",
    "activity_flags",
    "pooled_target",
    "zscore_features",
    "baseline_results",
    "forecast_frame",
    "forecast_eval",
    "eval_summary",
    "inactive_eval",
    "page_links",
    "calendar_features",
    "per_asset_eval",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    run(queries["asset_summary"](spark, sf_dir))  # start the engine before the clock
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": pathlib.Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
    }
    if "per_asset_eval" in seconds:
        # 4 features x 10 horizons of the five active series
        line["models_per_sec"] = round(200 / seconds["per_asset_eval"], 2)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
