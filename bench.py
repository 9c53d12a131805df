"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: prints one JSON line.

Each query runs twice and the second run counts; results go to Spark's noop sink, so nothing is collected. The
model fit runs once, at the full size of 200 trees unless ``BENCH_TREES`` says otherwise.
"""

from __future__ import annotations

import json
import os
import sys
import time

from larder.operators import forecast
from larder.registry import ENTRIES
from larder.session import build_session, written
from larder.sources.standins import Standins

HEADLINE = (
    "in6_stock_alerts in10_optimization_summary fc3_daily_demand fc7_demand_lags fc13_forecast_grid "
    "cb1_hourly_pattern cb4_temporal_insights cb5_basket_stats cb6_top_items cb8_co_purchased_items "
    "cb9_restaurant_performance db1_dashboard_hourly db6_dashboard_summary me1_item_performance me5_menu_matrix "
    "me9_pricing_suggestions me17_price_stats me21_item_scores pf1_profile_orders pf2_profile_order_items "
    "pf12_item_revenue dq1_quality_report lg1_trim_history st6_sessions in20_weekly_recommendations"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    trees = int(os.environ.get("BENCH_TREES", "200"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    t = Standins(spark, sf_dir)
    started = time.perf_counter()
    demand = written(forecast.demand_features(t.order_items, t.orders), "demand")
    fitted = forecast.train_forecaster(forecast.feature_matrix(demand), trees=trees)
    seconds[f"fc9_train_{trees}_trees"] = round(time.perf_counter() - started, 3)
    print(fitted.metrics, file=sys.stderr)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
