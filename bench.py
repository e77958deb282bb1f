"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The log is written once as a Parquet log table, as a log exists before it is queried.
Every time below then covers reading that table, decoding its bytes, and the operator.
Median of three warm runs; ``rows_per_sec`` is the rows of the tables a query reads, each
counted once, over that time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventfold import registry  # noqa: E402
from eventfold.session import build_session, work_dir  # noqa: E402
from eventfold.sources import order_log  # noqa: E402

HEADLINE = [
    "decode_event", "fold_guarded", "violations", "changelog_rows", "compact_changelog", "restore_full",
    "compact_latest", "attempt_budget", "due_gate_hol", "analytics_counts", "analytics_running",
    "guard_transition", "table_from_events", "log_bounds", "partition_skew", "group_divergence",
]
#: Queries that read other tables than the log.
OTHER_TABLES = {"compact_latest": ("events",), "guard_transition": ("orders", "lineitem")}
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g", spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    started = time.time()
    path = work_dir(spark, "bench-log")
    order_log.lifecycle_log(spark, sf_dir).repartition(int(cpus), "key").write.parquet(path)
    order_log.use_log_table(sf_dir, path)
    rows = spark.read.parquet(path).count()
    setup = time.time() - started
    other = {
        name: sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables)
        for name, tables in OTHER_TABLES.items()
    }
    times, rates = {}, {}
    for name in names:
        taken = []
        for i in range(RUNS + 1):
            t = time.time()
            registry.RUNS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.time() - t)
        times[name] = round(statistics.median(taken), 3)
        rates[name] = round(other.get(name, rows) / times[name])
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "log_rows": rows,
                "rows_per_sec": rates, "setup_sec": round(setup, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
