"""Headline benchmark: seconds per query, one JSON line on stdout.

Every query is run over its whole tables and written to the no-op sink, so that all columns of
all rows are produced but nothing is collected. Each query runs twice; `queries` and `value` are
first runs, `warm` the second ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulseline.plans.catalog import ENTRIES  # noqa: E402
from pulseline.plans.registry import runner  # noqa: E402
from pulseline.session import build_session, release  # noqa: E402

HEADLINE = (
    "silver_positions", "silver_enriched", "observed_headways", "bunching_hotspots", "reliability_scores",
    "corridor_priority", "hotspots_with_stops", "project_to_shape", "projection_quality", "route_hourly_stability",
    "route_eligibility", "gps_update_frequency", "route_speed_stats", "daily_quality_fingerprint", "route_activity",
    "vehicle_activity", "pareto_concentration", "subtype_correlation", "stop_reference", "critical_corridors",
    "scenario_matrix", "stress_decomposition", "route_question", "grade_answers", "density_grid", "stream_bunching",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("pulseline-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # warm the session, not the queries
    seconds: dict[str, float] = {}
    warm: dict[str, float] = {}
    for taken in (seconds, warm):  # a first run compiles code and starts workers
        for name in HEADLINE:
            started = time.perf_counter()
            runner(ENTRIES[name])(spark, folder).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - started, 3)
            release(spark)
    release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "warm": warm, "warm_total": round(sum(warm.values()), 3), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
