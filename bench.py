"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tarifflake.plans import catalogue
from tarifflake.session import local_session

HEADLINE = [
    "c7a_live_rates", "c16_search_hotel_rates", "c05_dated_rate_load", "c06_trim_overlaps", "c21_price_hotel_stays", "c22_price_packages",
    "a08_trip_totals", "a09_dashboard_figures", "a20_compare_price_grids", "c20_expiring_soon", "a14_daily_usage", "c31_hotel_history",
    "a04_package_cards", "j06_suggested_addons", "io03_content_dedup",
    "c7b_rate_changes", "c18_search_packages", "w08_version_base",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["a14_daily_usage"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
