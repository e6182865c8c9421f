"""Counters of a running ingest query as a status history."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tracewell.model import LOGS, METRICS, SPANS
from tracewell.operators.status import COUNTERS
from tracewell.sources.store import Reader

SNAPSHOT_SCHEMA = (
    "process string, time_unix_nano bigint, id bigint, committed_logs bigint, committed_spans bigint,"
    " committed_metric_points bigint, deleted_logs bigint, deleted_spans bigint, deleted_metric_points bigint,"
    " rejected bigint, store_ready boolean, last_error string, pipeline_ready boolean"
)


def snapshot(
    reader: Reader, process: str, pipeline_ready: bool = True, last_error: str = "", now_nanos: int | None = None
) -> DataFrame:
    """One row of status history, ready to be appended to a history table."""
    state = reader.state
    now = time.time_ns() if now_nanos is None else now_nanos
    row = (
        process,
        now,
        state.version,
        *[state.committed[signal] for signal in (LOGS, SPANS, METRICS)],
        *[state.deleted[signal] for signal in (LOGS, SPANS, METRICS)],
        state.rejected,
        not last_error,
        last_error,
        pipeline_ready,
    )
    return reader.spark.createDataFrame([row], SNAPSHOT_SCHEMA)


def observed_counts(records: DataFrame, name: str) -> DataFrame:
    """``records`` with counters that query progress reports show under ``name``."""
    return records.observe(
        name,
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("received_at_unix_nano"), F.lit(0)).alias("last_received_at"),
    )


class StatusHistory(StreamingQueryListener):
    """Appends a row to the status history in ``folder`` at each progress report that holds observed counters.

    ``observed`` maps names given to `observed_counts` to the lifetime counters they add to, such as ``{"logs":
    "committed_logs"}``. Counters start at zero with each listener, as those of a process do. A query that ends with an
    error adds a row that is not ready. Register it with ``spark.streams.addListener``; a row is a small file of its own.
    """

    def __init__(self, spark: SparkSession, folder: str, process: str, observed: dict[str, str]):
        unknown = set(observed.values()) - set(COUNTERS)
        if unknown:
            raise ValueError(f"no such counters: {', '.join(sorted(unknown))}")
        self.spark, self.folder, self.process, self.observed = spark, folder, process, observed
        self.totals = dict.fromkeys(COUNTERS, 0)
        self.rows = 0
        self.ours: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics
        found = [name for name in self.observed if name in metrics]
        for name in found:
            self.totals[self.observed[name]] += metrics[name]["records"]
        if found:
            self.ours.add(str(event.progress.runId))
            self._append("")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception and str(event.runId) in self.ours:
            self._append(event.exception.splitlines()[0])

    def _append(self, error: str) -> None:
        self.rows += 1
        counters = [self.totals[name] for name in COUNTERS]
        row = (self.process, time.time_ns(), self.rows, *counters, True, error, not error)
        self.spark.createDataFrame([row], SNAPSHOT_SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The status history below ``folder``, as `tracewell.operators.status.activity` takes it."""
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(folder)
