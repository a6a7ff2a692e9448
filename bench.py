"""Times the headline queries and prints one JSON line.

Each time is the wall time of the whole query, scan and cleaning included, with
its result written to the no-op sink; the best of ``BENCH_REPEAT`` runs after
one warm-up.
"""

from __future__ import annotations

import json
import os
import time

from salesmart.plans.registry import queries
from salesmart.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))

HEADLINE = [
    "dq_profile",
    "dq_report",
    "clean_sales",
    "enrich_sales",
    "units_by_warehouse",
    "warehouse_summary",
    "store_summary",
    "product_features",
    "time_summary",
    "top_products",
    "kpi_snapshot",
    "star_integrity",
    "q1_warehouse_units",
    "q2_top_products_by_name",
    "q3_monthly_trend",
    "q4_stockout_risk",
    "q5_tier_rollup",
    "q6_weekend_split",
    "q7_store_in_warehouse",
    "scenario_forecast",
    "inventory_status",
]

# Long chains of jobs, timed once: the batch run alone, and with star schema and k-means.
CHAINS = ["run_batch", "run_full"]


def timed(spark, query) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS)
    registered = queries()
    timed(spark, registered["warehouse_summary"])
    seconds = {q: min(timed(spark, registered[q]) for _ in range(REPEAT)) for q in HEADLINE}
    seconds |= {q: timed(spark, registered[q]) for q in CHAINS}
    spark.stop()
    result = {
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {q: round(t, 3) for q, t in seconds.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
