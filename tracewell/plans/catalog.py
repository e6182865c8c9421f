"""Output columns of the built-in views, known without reading data."""

from __future__ import annotations

from tracewell.model import CONTEXT_COLUMNS, METRIC_IDENTITY, SERIES_IDENTITY

_CONTEXT = [*CONTEXT_COLUMNS, "attributes"]
_POINT_HEAD = ["id", "received_at", "time", "start_time", "resource_id", *SERIES_IDENTITY]
_GROUP_TAIL = ["point_count", "no_recorded_value_count", "first_time", "last_time", "last_received_at"]

_VIEWS = {
    "services": ["service_name", "logs", "spans", "metric_points", "last_received_at"],
    "logs": [
        "id", "received_at", "time", "service_name", "severity_number", "severity_text",
        "trace_id", "span_id", "body", *_CONTEXT, "event_name", "observed_time", "flags",
    ],
    "spans": [
        "id", "received_at", "service_name", "trace_id", "span_id", "parent_span_id", "name",
        "kind", "status_code", "status_message", "start_time", "end_time", "duration_ms",
        *_CONTEXT, "events", "links",
    ],
    "trace": [
        "kind", "id", "received_at", "time", "service_name", "trace_id", "span_id",
        "parent_span_id", "name", "severity_text", "start_time", "end_time", "body",
        "status_code", "status_message", "span_kind", "duration_ms", *_CONTEXT, "events", "links",
    ],
    "metrics points": [
        *_POINT_HEAD, "description", "flags", "number_kind", "number_int", "number_double",
        "aggregate_count", "aggregate_sum", "aggregate_min", "aggregate_max", "bucket_counts",
        "explicit_bounds", "scale", "zero_count", "zero_threshold", "positive", "negative",
        "quantile_values", "exemplars",
    ],
    "metrics rate": [
        *_POINT_HEAD, "value", "flags", "interval_start", "interval_end", "delta_value",
        "rate_per_second", "rate_reason", "gap_seconds",
    ],
    "metrics list": ["resource_id", *METRIC_IDENTITY, "series_count", *_GROUP_TAIL],
    "metrics series": ["resource_id", *SERIES_IDENTITY, *_GROUP_TAIL],
}

_METRIC_SUMMARY = [
    "service_name", "resource_id", "scope_name", "metric_name", "metric_type", "unit", "temporality",
]

# The columns of the short, human-readable form of each view.
SUMMARY_COLUMNS = {
    "logs": ["time", "service_name", "severity_number", "body", "trace_id", "span_id"],
    "spans": [
        "start_time", "service_name", "name", "kind", "status_code", "duration_ms", "trace_id", "span_id",
    ],
    "trace": [
        "offset_ms", "duration_ms", "service_name", "kind", "span_kind", "name", "status_code",
        "status_message", "span_id", "parent_span_id", "body",
    ],
    "metrics list": [*_METRIC_SUMMARY, "monotonic", "series_count", "point_count", "last_received_at"],
    "metrics series": [*_METRIC_SUMMARY, "attributes", "point_count", "first_time", "last_time"],
    "metrics rate": [
        "time", "service_name", "resource_id", "metric_name", "unit", "attributes",
        "rate_per_second", "rate_reason", "gap_seconds",
    ],
    "metrics points": [
        "time", *_METRIC_SUMMARY, "attributes", "number_int", "number_double", "aggregate_count",
        "aggregate_sum", "aggregate_min", "aggregate_max", "flags",
    ],
}

DISCOVERY = ("metrics list", "metrics series")


def output_columns(view: str, payload: bool = False) -> list[str]:
    """Columns of a built-in view in order."""
    if view not in _VIEWS:
        raise ValueError(f"no built-in columns for {view!r}")
    if payload and view in DISCOVERY:
        raise ValueError("summaries of metrics have no payload; points and rates do")
    columns = list(_VIEWS[view])
    if payload and view != "services":
        columns.append("payload")
    if view == "trace":
        columns.append("offset_ms")
    return columns
