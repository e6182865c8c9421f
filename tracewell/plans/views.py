"""Built-in views: logs, spans, services, traces and metrics.

Each function takes signal tables (any DataFrame with the columns of ``tracewell.model``)
and returns a lazy DataFrame. Paging and formatting come after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.attributes import resource_id
from tracewell.functions.times import millis_between
from tracewell.model import LOGS, METRIC_IDENTITY, METRICS, NO_RECORDED_VALUE, SERIES_IDENTITY, SPANS
from tracewell.operators.rate import counter_rate
from tracewell.plans import catalog
from tracewell.plans.filters import Filters, common, hex_id, select_logs, select_metrics, select_spans, with_attributes
from tracewell.session import work_folder

_RENAMED = {
    "received_at": "received_at_unix_nano",
    "start_time": "start_time_unix_nano",
    "end_time": "end_time_unix_nano",
    "body": "body_json",
    "payload": "payload_json",
}


def _project(table: DataFrame, view: str, payload: bool, computed: dict[str, Column]) -> DataFrame:
    def column(name: str) -> Column:
        if name in computed:
            return computed[name].alias(name)
        return F.col(_RENAMED.get(name, name)).alias(name)

    return table.select(*[column(name) for name in catalog.output_columns(view, payload)])


def duration_ms() -> Column:
    """Span duration, only where both ends are known and in order."""
    start, end = F.col("start_time_unix_nano"), F.col("end_time_unix_nano")
    return F.when((start > 0) & (end >= start), millis_between(start, end))


def logs(table: DataFrame, filters: Filters, payload: bool = False, ordered: bool = True) -> DataFrame:
    """Log records, newest first."""
    selected = select_logs(table, filters, LOGS)
    view = _project(selected, "logs", payload, {"time": F.col("time_unix_nano")})
    return view.orderBy(F.desc("id")) if ordered else view


def spans(table: DataFrame, filters: Filters, payload: bool = False, ordered: bool = True) -> DataFrame:
    """Spans, newest first."""
    selected = select_spans(table, filters, SPANS)
    view = _project(selected, "spans", payload, {"duration_ms": duration_ms()})
    return view.orderBy(F.desc("id")) if ordered else view


def services(log_table: DataFrame, span_table: DataFrame, metric_table: DataFrame, filters: Filters) -> DataFrame:
    """Record counts per service and signal with the latest receipt.

    Each signal is counted on its own before the union, so that only one small row per
    service and signal is left to combine.
    """
    parts = []
    for signal, counter, table in [
        (LOGS, "logs", log_table),
        (SPANS, "spans", span_table),
        (METRICS, "metric_points", metric_table),
    ]:
        counted = (
            with_attributes(common(table, signal, filters), filters)
            .groupBy("service_name")
            .agg(F.count(F.lit(1)).alias(counter), F.max("received_at_unix_nano").alias("last_received_at"))
        )
        parts.append(counted)
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
    return (
        combined.groupBy("service_name")
        .agg(
            total("logs"),
            total("spans"),
            total("metric_points"),
            F.max("last_received_at").alias("last_received_at"),
        )
        .orderBy("service_name")
    )


def trace(log_table: DataFrame, span_table: DataFrame, trace_id: str, payload: bool = False) -> DataFrame:
    """Timeline of one trace: its spans and logs in order of event time."""
    wanted = F.col("trace_id") == hex_id(trace_id, "trace ID", 32)
    timeline = traces(log_table.where(wanted), span_table.where(wanted), payload)
    return timeline.orderBy("time", "kind", "id")


def traces(log_table: DataFrame, span_table: DataFrame, payload: bool = False) -> DataFrame:
    """Timelines of all traces given; ``offset_ms`` counts from the start of each trace.

    The start is aggregated per trace and joined back rather than taken from a window:
    partial aggregation and the skew handling of joins keep a huge trace off one task.
    """
    received = F.col("received_at_unix_nano")

    def at(column: str) -> Column:
        # Receipt time stands in for a missing event time.
        return F.when(F.col(column) == 0, received).otherwise(F.col(column))

    span_rows = _project(
        span_table.where(F.col("trace_id").isNotNull()),
        "trace",
        payload,
        {
            "kind": F.lit("span"),
            "time": at("start_time_unix_nano"),
            "severity_text": F.lit(None).cast("string"),
            "body": F.lit(None).cast("string"),
            "span_kind": F.col("kind"),
            "duration_ms": duration_ms(),
            "offset_ms": F.lit(None).cast("double"),
        },
    ).drop("offset_ms")
    none = {
        "parent_span_id": "string", "start_time": "bigint", "end_time": "bigint", "status_code": "int",
        "status_message": "string", "span_kind": "int", "duration_ms": "double", "offset_ms": "double",
    }
    log_rows = _project(
        log_table.where(F.col("trace_id").isNotNull()),
        "trace",
        payload,
        {
            "kind": F.lit("log"),
            "time": at("time_unix_nano"),
            "name": F.col("event_name"),
            "events": F.lit("[]"),
            "links": F.lit("[]"),
            **{name: F.lit(None).cast(kind) for name, kind in none.items()},
        },
    ).drop("offset_ms")
    timeline = span_rows.unionByName(log_rows)
    # Written first, so that its size is known: unless there are very many traces, no timeline row is shuffled for the join.
    begun = timeline.groupBy("trace_id").agg(F.min("time").alias("_begun"))
    folder = work_folder(begun.sparkSession, "trace-begins")
    begun.write.parquet(folder)
    begun = begun.sparkSession.read.schema(begun.schema).parquet(folder)
    return timeline.join(begun, "trace_id").select(
        *timeline.columns, millis_between(F.col("_begun"), F.col("time")).alias("offset_ms")
    )


def _resource() -> Column:
    return resource_id(F.col("resource_attributes"), F.col("resource_schema_url"))


def metric_points(table: DataFrame, filters: Filters, payload: bool = False, ordered: bool = True) -> DataFrame:
    """Metric data points with full identity, newest first."""
    selected = select_metrics(table, filters, METRICS)
    view = _project(
        selected, "metrics points", payload, {"time": F.col("time_unix_nano"), "resource_id": _resource()}
    )
    return view.orderBy(F.desc("id")) if ordered else view


def metric_series(table: DataFrame, filters: Filters, ordered: bool = True) -> DataFrame:
    """One row per metric stream, point attributes included."""
    selected = select_metrics(table, filters, METRICS)
    grouped = selected.groupBy(*SERIES_IDENTITY).agg(*_group_totals())
    view = grouped.select(_resource().alias("resource_id"), "*")
    return view.orderBy(*SERIES_IDENTITY) if ordered else view


def metric_list(table: DataFrame, filters: Filters, ordered: bool = True) -> DataFrame:
    """One row per metric descriptor with the number of its series.

    Series are grouped first and then rolled up, so a descriptor with very many points
    reaches the second exchange as one row per series.
    """
    series = select_metrics(table, filters, METRICS).groupBy(*SERIES_IDENTITY).agg(*_group_totals())
    grouped = series.groupBy(*METRIC_IDENTITY).agg(
        F.count(F.lit(1)).alias("series_count"),
        F.sum("point_count").alias("point_count"),
        F.sum("no_recorded_value_count").alias("no_recorded_value_count"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("last_received_at").alias("last_received_at"),
    )
    view = grouped.select(_resource().alias("resource_id"), "*")
    return view.orderBy(*METRIC_IDENTITY) if ordered else view


def _group_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("point_count"),
        F.count_if(F.col("flags").bitwiseAND(NO_RECORDED_VALUE) != 0).alias("no_recorded_value_count"),
        F.min("time_unix_nano").alias("first_time"),
        F.max("time_unix_nano").alias("last_time"),
        F.max("received_at_unix_nano").alias("last_received_at"),
    ]


def metric_rate(
    table: DataFrame, filters: Filters, payload: bool = False, ordered: bool = True, **skew
) -> DataFrame:
    """Rates of one metric, newest first. Rates see every selected point; page afterwards."""
    if not filters.name.strip():
        raise ValueError("metric rates require a metric name")
    selected = select_metrics(table, filters, METRICS)
    return rates(selected, payload, ordered, **skew)


def rates(selected: DataFrame, payload: bool = False, ordered: bool = True, **skew) -> DataFrame:
    """Rate view over any set of metric points, many metrics at once."""
    needed = [
        "id", "received_at_unix_nano", "time_unix_nano", "start_time_unix_nano", *SERIES_IDENTITY,
        "number_int", "number_double", "flags", *(["payload_json"] if payload else []),
    ]
    rated = counter_rate(selected.select(*needed), **skew)
    view = _project(
        rated, "metrics rate", payload, {"time": F.col("time_unix_nano"), "resource_id": _resource()}
    )
    return view.orderBy(F.desc("time"), F.desc("id")) if ordered else view


_EXEMPLARS = "array<struct<traceId: string, spanId: string, timeUnixNano: string, asInt: string, asDouble: double>>"


def exemplars(points: DataFrame) -> DataFrame:
    """One row per exemplar of the metric points, with the trace it was recorded in."""
    one = F.col("_exemplar")
    listed = points.where(F.col("exemplars") != "[]").select(
        "id", "metric_name", F.explode(F.from_json("exemplars", _EXEMPLARS)).alias("_exemplar")
    )
    number = F.coalesce(one["asInt"].try_cast("double"), one["asDouble"])
    return listed.select(
        "id",
        "metric_name",
        F.lower(one["traceId"]).alias("trace_id"),
        F.lower(one["spanId"]).alias("span_id"),
        one["timeUnixNano"].try_cast("bigint").alias("exemplar_time"),
        number.alias("exemplar_value"),
    )


def exemplar_traces(points: DataFrame, log_table: DataFrame, span_table: DataFrame) -> DataFrame:
    """Exemplars with the extent of their trace: spans, logs, first and last event time.

    Only traces with an exemplar are read on, as three narrow columns, and reduced to one row each before the join; the
    timeline of a chosen trace comes from :func:`trace`.
    """
    found = exemplars(points)
    wanted = found.select("trace_id").distinct()

    def events(table: DataFrame, kind: str, time: str) -> DataFrame:
        at = F.when(F.col(time) == 0, F.col("received_at_unix_nano")).otherwise(F.col(time))
        rows = table.where(F.col("trace_id").isNotNull()).select("trace_id", F.lit(kind).alias("kind"), at.alias("time"))
        return rows.join(wanted, "trace_id", "left_semi")

    timeline = events(span_table, "span", "start_time_unix_nano").unionByName(events(log_table, "log", "time_unix_nano"))
    extent = timeline.groupBy("trace_id").agg(
        F.count_if(F.col("kind") == "span").alias("spans"),
        F.count_if(F.col("kind") == "log").alias("logs"),
        F.min("time").alias("trace_begin"),
        F.max("time").alias("trace_end"),
    )
    return found.join(extent, "trace_id", "left")
