"""Headline queries at one scale; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose the run."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from evigrid.plans import QUERIES
from evigrid.session import local_session

HEADLINE = (
    "t1_job_page", "f2_job_titles", "a7_check_rollup", "j1_merged_pins", "j2_review_differences", "w2_symbol_layout", "x1_package_hints",
    "x3_dimensions", "x8_page_texts", "t5_ranked_evidence", "x9_stride_chunks", "x10_markdown_sections", "t9_hybrid_search", "j4_assigned_regions",
    "j5_nearest_lines", "j7_pad_clearances", "a9_fused_parameters", "v2_chain_conflicts", "v6_pad_geometry", "x12_verify_records", "w14_stage_durations",
    "w11_conversation_window", "j17_continued_tables", "a19_route_gate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(app="evigrid-bench")
    # One untimed pass starts the workers and compiles the common paths.
    QUERIES["t1_job_page"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds, rate = {}, {}
    for name in names:
        start, seen = time.perf_counter(), Observation()
        QUERIES[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        rate[name] = round(seen.get["rows"] / max(seconds[name], 1e-3))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_sec": rate,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
