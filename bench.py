"""Benchmark of the headline queries; prints one JSON line.

The telemetry tables and requests are derived from the given tables once, as Parquet, the
way a store holds them; that time is reported as ``prepare_sec`` and not part of the total.

Environment: BENCH_SF_DIR (folder of tables), BENCH_CPUS (local cores), BENCH_RUNS
(timed runs after one warm-up; the median counts), BENCH_QUERIES (comma-separated subset).
Each run computes every row and column of the result and writes it to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.session import local_session, work_folder  # noqa: E402
from workload import derived  # noqa: E402
from workload.queries import queries  # noqa: E402

HEADLINE = [
    "metric_rate",
    "rate_reason_counts",
    "metric_list",
    "metric_series",
    "services",
    "logs_min_level",
    "logs_attr_int",
    "spans_filtered",
    "spans_attr_bool",
    "trace_timeline",
    "trace_single",
    "exemplar_traces",
    "log_dedup",
    "logs_unseen",
    "span_conflicts",
    "span_accepted",
    "retention_age",
    "retention_size",
    "store_status",
    "activity",
    "log_summary",
    "adhoc_sql",
    "otlp_logs_ingest",
    "otlp_traces_ingest",
    "otlp_metrics_ingest",
]


PREPARED = ["logs", "spans", "metric_points", "log_requests", "span_requests", "metric_requests", "status_history"]


def _prepare(spark, folder: str) -> None:
    target = work_folder(spark, "bench")
    for name in PREPARED:
        table = getattr(derived, name)(spark, folder)
        table.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{target}/{name}")
    spark.conf.set(derived.PREPARED, target)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, shuffle_partitions=cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    registered = queries()
    started = time.perf_counter()
    _prepare(spark, folder)
    prepare_seconds = round(time.perf_counter() - started, 3)
    results: dict[str, float] = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        results[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {results[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "telemetry_queries_total",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "shuffle_partitions": cpus,
                "runs": runs,
                "prepare_sec": prepare_seconds,
            }
        )
    )


if __name__ == "__main__":
    main()
