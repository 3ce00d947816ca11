"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

RUNS = 3
HEADLINE = ["pool_bench", "verdict_by_case", "topk_explanations", "balanced_exposure", "unit_pool", "ocr_top6_chrono", "observation_filter", "visual_top4_chrono", "monotonic_violations", "response_contract", "frame_sampler_8", "bbox_union", "scorer_exposure", "verified_cases", "response_json_contract", "text_frame_units", "recogniser_replies", "exact_means", "claims_against_frames"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from evidentia.plans import catalogue

    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            t = time.perf_counter()
            catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, median seconds, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
