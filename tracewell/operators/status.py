"""Status history: counter deltas, activity reports and their severity.

A history holds one snapshot per row: ``process``, ``time_unix_nano``, ``id``, the lifetime
counters, ``store_ready``, ``last_error``, ``pipeline_ready`` and ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.previous import with_previous

COUNTERS = [
    "committed_logs",
    "committed_spans",
    "committed_metric_points",
    "deleted_logs",
    "deleted_spans",
    "deleted_metric_points",
    "rejected",
]
# The fields whose change makes an interval worth reporting.
WATCHED = [*COUNTERS, "store_ready", "last_error", "pipeline_ready"]

ACTIVITY_SECONDS = 10  # fixed value: reporting cadence
HEARTBEAT_SECONDS = 60  # fixed value: longest time without a report


def counter_delta(previous: Column, current: Column) -> Column:
    """Growth of a lifetime counter; after a restart it counts from zero again."""
    return F.when(current < previous, current).otherwise(current - previous)


def changed(fields: list[str] = WATCHED) -> Column:
    """True where any watched field differs from the previous snapshot."""
    differs = F.lit(False)
    for name in fields:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"previous_{name}"))
    return differs


def snapshots_with_previous(history: DataFrame, **skew) -> DataFrame:
    """Each snapshot with the one before it of the same process."""
    return with_previous(history, ["process"], ["time_unix_nano", *WATCHED], **skew).drop(
        "same_time", "previous_same_time"
    )


def activity(
    history: DataFrame, interval_seconds: int = ACTIVITY_SECONDS, heartbeat_seconds: int | None = None, **skew
) -> DataFrame:
    """One report per process and interval in which something changed.

    An interval is judged by its last snapshot, as a ticking reporter would see it. With ``heartbeat_seconds``
    (``HEARTBEAT_SECONDS`` is usual) there is also a report whenever so much time has passed since the last one (or
    since the first snapshot) up to the last snapshot of the process; it repeats the counters and shows no growth.
    """
    interval = interval_seconds * 1_000_000_000
    tick = F.col("time_unix_nano") - F.pmod(F.col("time_unix_nano"), F.lit(interval).cast("bigint")) + interval
    order = F.struct("time_unix_nano", "id")
    ticked = (
        history.withColumn("_tick", tick)
        .groupBy("process", "_tick")
        .agg(*[F.max_by(name, order).alias(name) for name in WATCHED])
        .select("process", F.col("_tick").alias("time_unix_nano"), F.col("_tick").alias("id"), *WATCHED)
    )
    compared = snapshots_with_previous(ticked, **skew)
    started = F.col("previous_time_unix_nano").isNull()
    reported = compared.where(~started & changed())
    if heartbeat_seconds is not None:
        names = ["process", "time_unix_nano", "id", *WATCHED]
        reported = reported.unionByName(_idle(compared.where(started | changed()).select(names), ticked, heartbeat_seconds, **skew))
    return _reports(reported)


def _idle(reports: DataFrame, ticked: DataFrame, seconds: int, **skew) -> DataFrame:
    """Heartbeats between the reports of a process, and after the last one until its last snapshot."""
    step = F.lit(seconds * 1_000_000_000).cast("bigint")
    # A border behind the last interval stands for the end of the process.
    none = [F.lit(None).cast(field.dataType).alias(field.name) for field in reports.schema if field.name in WATCHED]
    ends = ticked.groupBy("process").agg((F.max("time_unix_nano") + 1).alias("time_unix_nano"))
    ends = ends.select("process", "time_unix_nano", F.col("time_unix_nano").alias("id"), *none)
    borders = snapshots_with_previous(reports.unionByName(ends), **skew).where(F.col("previous_time_unix_nano").isNotNull())
    first, border = F.col("previous_time_unix_nano") + step, F.col("time_unix_nano")
    times = F.explode(F.when(first < border, F.sequence(first, border - 1, step)))
    same = [F.col(f"previous_{name}") for name in WATCHED]
    beats = borders.select("process", times.alias("time_unix_nano"), *[x.alias(name) for x, name in zip(same, WATCHED)], *same)
    before = F.col("time_unix_nano") - step
    return beats.withColumns({"id": F.col("time_unix_nano"), "previous_time_unix_nano": before})


def _reports(compared: DataFrame) -> DataFrame:
    grown = {name: counter_delta(F.col(f"previous_{name}"), F.col(name)) for name in COUNTERS}
    return compared.select(
        "process",
        F.col("time_unix_nano").alias("reported_at"),
        grown["committed_logs"].alias("logs_written"),
        grown["committed_spans"].alias("spans_written"),
        grown["committed_metric_points"].alias("metric_points_written"),
        grown["deleted_logs"].alias("logs_deleted"),
        grown["deleted_spans"].alias("spans_deleted"),
        grown["deleted_metric_points"].alias("metric_points_deleted"),
        grown["rejected"].alias("requests_rejected"),
        F.col("committed_logs").alias("logs_total"),
        F.col("committed_spans").alias("spans_total"),
        F.col("committed_metric_points").alias("metric_points_total"),
        (F.col("pipeline_ready") & F.col("store_ready")).alias("ready"),
        severity().alias("severity"),
    )


def severity() -> Column:
    """``warn`` where something is not ready or requests were rejected, else ``info``."""
    trouble = (
        ~F.col("pipeline_ready") | ~F.col("store_ready") | (F.col("rejected") > F.col("previous_rejected"))
    )
    return F.when(F.coalesce(trouble, F.lit(False)), "warn").otherwise("info")
