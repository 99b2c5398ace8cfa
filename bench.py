"""Headline timings: median of three runs after a warm-up, one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = [
    "who_is_told",
    "j01_1_rules",
    "j01_10_rules",
    "j01_100_rules",
    "j01_2000_rules",
    "a02_rule_documents",
    "k06_mail_notifications",
    "f02_match",
    "f04_phrase",
    "p04_tokenize",
    "normalise_events",
    "k03_upsert_latest",
    "k04_write_metrics",
    "w02_assign_collection",
    "w03_suppress_repeats",
    "w04_micro_batches",
    "t03_sliding_counts",
    "t04_absence",
    "t02_alert_stream",
    "m02_roll",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loglake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loglake-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from loglake.registry import QUERIES

    timings = {}
    for name in names:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
