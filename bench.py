"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "closed_window_stats", "scan_range_half_open", "latest_n", "csv_stats", "stored_range_scan", "partition_export",
    "csv_rolling", "deadband_batch", "ingest_batch", "change_only", "sample_interval", "queue_last_n", "folder_rollup",
    "sync_tags", "prune_uploaded", "prune_stored", "partition_cycle", "csv_run", "health_plcs", "connection_state",
    "discover_tags", "stream_ingest", "stream_closed_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidemark-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-bench-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["window_stats"](spark, sf_dir).collect()  # start the JVM's compilers and the file cache
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    readings = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    result = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "readings": readings,
    }
    if "stream_ingest" in seconds:
        result["ingest_readings_per_second"] = round(readings / seconds["stream_ingest"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
