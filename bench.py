"""Time the headline queries at $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelake.plans import catalog  # noqa: E402
from tracelake.plans.session import build_session  # noqa: E402

HEADLINE = [
    "A14_bin_summary", "A2_bin_stats", "A8_coverage", "E10_event_report", "E7_max_hourly_burden", "F7_derived_features", "F8_independent_mask",
    "J1_segment_merge", "Q5_null_suppressed", "Q6_rejection_report", "Q11_duplicate_columns", "P1_column_profile", "P4_rank_correlation",
    "R3_midpoint_rows", "S1_read_export", "S6_quick_scan", "T8_clock_correction", "T15_step_support", "X1_patient_wide", "C12_schema",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench")
    names = [n for n in (os.environ.get("BENCH_QUERIES") or ",".join(HEADLINE)).split(",") if n]
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
