"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated
names, or ``all``). Each result is fully computed into Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from traceloom.session import build_session

HEADLINE = [
    "timestamped_ranges",
    "ipc_spans",
    "sliding_window",
    "raw_ipc",
    "asof_forward_left",
    "ancestor_walk",
    "full_syscalls",
    "on_cpu_syscalls",
    "kernel_context_switches",
    "errors_and_ranges",
    "error_gaps",
    "error_free_ranges",
    "range_cdf",
    "insn_class_share",
    "iteration_latency",
    "interval_overlap_join",
    "v_samples",
    "v_calls",
    "decode_pwrx",
    "connection_statistics",
    "log_normalize",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
