"""Headline timings: one JSON line on stdout. Each query is forced whole through a no-op sink."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelkite.models import arima, decomposable, linear, trees  # noqa: E402
from panelkite.operators import eda, features  # noqa: E402
from panelkite.plans.queries import QUERIES, SEG  # noqa: E402
from panelkite.plans.training import train_model  # noqa: E402
from panelkite.session import local_session, written  # noqa: E402
from panelkite.sources.panel import daily_panel  # noqa: E402

BASE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Registered queries, each from the raw tables.
NAMES = (
    "daily_panel_by_segment", "minimal_features", "full_features", "ewm_mean", "validation_report",
    "exact_quantiles_rows", "clean_sales", "series_analysis", "acf_curve", "boxplot_stats", "fold_metrics",
    "linear_weekday_forecast", "ensemble_forecast", "sessionize", "streamed_sessions",
)
WIDE = ["c_mktsegment", "c_nationkey"]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS), memory="12g", app="bench")
    noop(QUERIES["daily_panel_by_segment"](spark, BASE))  # start the JVM paths and the Python workers
    noop(QUERIES["seasonal_arima_forecast"](spark, BASE))
    seconds: dict[str, float] = {}

    def timed(name, fn) -> None:
        start = time.time()
        fn()
        seconds[name] = round(time.time() - start, 3)

    for name in NAMES:
        timed(name, lambda: noop(QUERIES[name](spark, BASE)))

    wide = written(daily_panel(spark, BASE, WIDE), "wide")
    timed("full_features_125_series", lambda: noop(features.create_features(wide, WIDE, "full")))
    timed("profile_125_series", lambda: noop(eda.series_profile(wide, WIDE)))
    timed("decomposable_125_series", lambda: noop(decomposable.forecast(decomposable.fit(wide, WIDE), 30)))
    timed("arima_125_series", lambda: noop(arima.forecast(arima.fit(wide, WIDE), 30)))

    # Tune, fit, test, refit: the measured unit of the published training times, here for five series.
    narrow = written(daily_panel(spark, BASE, SEG), "narrow")
    for name, trials in ((linear.NAME, 10), (decomposable.NAME, 10), (arima.NAME, 10)):
        timed(f"train_tune_{name}", lambda: train_model(narrow, SEG, name, n_trials=trials))
    timed("train_boosted_trees", lambda: train_model(narrow, SEG, trees.BOOSTED, params={"n_estimators": 50}))
    timed("train_random_forest", lambda: train_model(narrow, SEG, trees.FOREST))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(BASE.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
