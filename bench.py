"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import gc
import json
import os
import sys
import time

from transitloom.plans import load_all
from transitloom.plans.base import QUERIES
from transitloom.session import STEPS, local_session

HEADLINE = [
    "hop_times", "template_stops", "trip_instances", "allocate_riders", "segment_loads", "next_arrivals", "positions", "bus_choice",
    "mc_trip_loads", "mc_segment_loads", "replication_stats", "route_legs", "primary_rank", "rerank", "classify_routes", "paired_comparison",
    "density_class", "latest_per_key", "rolling_median", "latency_stats", "chunk_assembly", "sweep_summary", "box_filter", "exact_dup", "k_routes", "recommend",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    # Start the JVM threads, the parquet reader and the code generator before anything is timed.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").agg({"l_quantity": "sum", "l_partkey": "max"}).collect()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        # Not timed: steps and shuffle files of a finished query go, so that the disk holds one query at a time.
        STEPS.release_others(spark)
        gc.collect()
        spark._jvm.System.gc()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
