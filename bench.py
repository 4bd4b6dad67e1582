"""Headline timings.  Prints one JSON line.

Every query writes its whole result to a sink that discards it.  Each is run
once to warm up and then timed ``BENCH_RUNS`` times; the median counts.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from lagfield.session import SETTINGS  # noqa: E402
from suite.queries import QUERIES  # noqa: E402

HEADLINE = [
    "correlation_map_job",
    "correlation_map_drift",
    "local_diffusion_map",
    "fit_2d",
    "fit_3d",
    "fit_fast_axis",
    "fit_job",
    "detrend_w3",
    "detrend_frames",
    "frame_autocorr_fft",
    "bootstrap_sd",
    "mean_projection",
    "tile_brightness",
    "median3",
    "drift_correct",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or not runs:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
