"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query is run to completion
into the no-op sink, so all of its columns are computed; the best of ``BENCH_RUNS`` runs counts.
"""

from __future__ import annotations

import json
import os
import time

from vitrina.session import local_session
from vitrina.workload.queries import QUERIES

HEADLINE = (
    "rep_kpis",
    "team_kpis",
    "daily_trend",
    "itinerary",
    "geo_enriched_visits",
    "geo_kpis",
    "geo_by_rep",
    "shelf_kpis",
    "stockouts_by_brand",
    "store_brand_report",
    "risk_products",
    "managerial_by_store",
    "zero_sales_kpis",
    "price_by_category",
    "price_distribution",
    "sellout_kpis",
    "sales_by_region",
    "top_products_sales",
    "monthly_rollup",
    "rollup_top_products",
    "rollup_channel_mix",
    "inventory_by_region",
    "stock_vs_sales",
    "clean_brand_report",
    "dump_load_rows",
    "repaired_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, app="bench")
    QUERIES["shelf_kpis"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
