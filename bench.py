"""Times the pipeline and the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the test-data folder, ``BENCH_CPUS`` the cores. The
first entries build the stored tables that the others read, and ingest yearly
gzip CSV files, as a user's pipeline would. Everything runs once, untimed, on the smallest neighbouring
folder first, so that the times show work and not the start of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcella.plans import queries as plans  # noqa: E402
from parcella.plans.store import open_store  # noqa: E402
from parcella.session import local_session  # noqa: E402
from parcella.sources import tables as io  # noqa: E402

HEADLINES = [
    "derive_sales",
    "two_house_by_year",
    "two_house_top10",
    "policy_before_after",
    "filter_impact",
    "borderline_types",
    "single_house_ppm2",
    "rows_per_year",
    "largest_sales_by_rows",
    "consistency_summary",
    "price_percentiles",
    "categorical_rundown",
    "sales_by_year",
    "ppm2_by_houses",
    "raw_area_percentiles",
    "dept_two_house_share",
    "giant_houses",
    "summary_stats",
    "summary_stats_specs",
    "trend_month",
    "trend_by_type",
    "choropleth_commune",
    "map_points",
    "price_scale",
    "sales_page",
    "browse_commune",
    "saved_search_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=max(8, int(cores)))
    store = open_store(spark, sf_dir)

    def execute(name, on):
        run, _ = plans.ALL[name]
        run(on).write.format("noop").mode("overwrite").save()

    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        warm = open_store(spark, smallest)
        for name in HEADLINES:
            execute(name, warm)

    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("build_raw_table", lambda: store.raw)
    csv = store.csv_path  # yearly gzip files, written untimed
    timed("ingest_csv", lambda: io.ingest(spark, csv, io.workspace(spark, "ingested"), store.csv_schema))
    timed("build_sales_table", lambda: store.sales)
    for name in HEADLINES:
        timed(name, lambda: execute(name, store))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "raw_rows": store.raw.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
