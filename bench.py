"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then three timed runs; the median is
reported. A run is a full execution of the query: its result goes to the
``noop`` sink, so every row and column is computed, plus any writes the query
itself does. (The first round timed ``count()``, which let the optimiser drop
columns; BENCH_METHOD=count still does that, to compare.) Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.registry import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = ["valid_groups", "file_changes", "folder_stats", "incremental_blocks",
            "group_files", "invalid_files", "cell_collisions", "csv_layout", "fileblock_rows",
            "apply_file_changes", "runs_snapshot", "sync"]


def run(df):
    if os.environ.get("BENCH_METHOD") == "count":
        df.count()
    else:
        df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="tessera-bench")
    times, errors = {}, {}
    for name in names:
        fn = QUERIES[name]
        try:
            run(fn(spark, sf_dir))  # warm-up
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                run(fn(spark, sf_dir))
                samples.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(samples), 3)
        except Exception as e:  # noqa: BLE001 - report and go on with the other queries
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
