"""Data model shared by every operator: enums, identities and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: OTLP codes and labels, limits, names of signals -----------------
SPAN_KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]
SPAN_STATUSES = ["unset", "ok", "error"]
SEVERITY_BANDS = ["trace", "debug", "info", "warn", "error", "fatal"]
SEVERITY_MINIMUM = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}
METRIC_TYPES = ["gauge", "sum", "histogram", "exponential_histogram", "summary"]
TEMPORALITIES = ["delta", "cumulative", "unspecified"]
NUMBER_KINDS = ["int", "double"]
UNKNOWN_SERVICE = "unknown_service"
REDACTED = "[REDACTED]"

MAX_NANOS = 2**63 - 1
MAX_VALUE_BYTES = 1 << 20
MAX_DEPTH = 16
MAX_PAYLOAD_BYTES = 64 << 20
MAX_LOG_RECORDS = 10_000
MAX_SPANS = 5_000
MAX_METRICS = 10_000
MAX_METRIC_POINTS = 10_000
NO_RECORDED_VALUE = 1  # data point flag bit
# -----------------------------------------------------------------------------------

LOGS = "otel_logs"
SPANS = "otel_spans"
METRICS = "otel_metric_points"
SIGNALS = [LOGS, SPANS, METRICS]  # also the eviction order at equal receipt time

CONTEXT_COLUMNS = [
    "resource_attributes",
    "resource_schema_url",
    "scope_name",
    "scope_version",
    "scope_attributes",
    "scope_schema_url",
]

METRIC_IDENTITY = [
    "service_name",
    *CONTEXT_COLUMNS,
    "metric_name",
    "metric_type",
    "unit",
    "temporality",
    "monotonic",
]
SERIES_IDENTITY = [*METRIC_IDENTITY, "attributes"]


def _struct(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "d": T.DoubleType()}
    fields = [item.rsplit(":", 1) for item in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


_CONTEXT = " ".join(f"{name}:s" for name in CONTEXT_COLUMNS) + " attributes:s"

# Every table keeps the extracted columns next to the payload, so that a query reads
# only the Parquet columns it needs and never parses the payload again.
LOG_SCHEMA = _struct(
    "id:l fingerprint:s received_at_unix_nano:l time_unix_nano:l service_name:s "
    "severity_number:i severity_text:s trace_id:s span_id:s request_id:s product_id:s "
    f"component:s op:s body_json:s payload_json:s {_CONTEXT} event_name:s observed_time:l "
    "flags:l payload_bytes:l"
)
SPAN_SCHEMA = _struct(
    "id:l fingerprint:s received_at_unix_nano:l trace_id:s span_id:s parent_span_id:s "
    "service_name:s name:s start_time_unix_nano:l end_time_unix_nano:l request_id:s "
    f"product_id:s payload_json:s {_CONTEXT} kind:i status_code:i status_message:s "
    "events:s links:s payload_bytes:l"
)
METRIC_SCHEMA = _struct(
    "id:l fingerprint:s received_at_unix_nano:l service_name:s metric_name:s metric_type:s "
    "start_time_unix_nano:l time_unix_nano:l number_kind:s number_int:l number_double:d "
    "aggregate_count:s aggregate_sum:d aggregate_min:d aggregate_max:d payload_json:s "
    f"{_CONTEXT} description:s unit:s temporality:s monotonic:i flags:l exemplars:s "
    "bucket_counts:s explicit_bounds:s scale:i zero_count:s zero_threshold:d positive:s "
    "negative:s quantile_values:s payload_bytes:l"
)
TABLE_SCHEMAS = {LOGS: LOG_SCHEMA, SPANS: SPAN_SCHEMA, METRICS: METRIC_SCHEMA}

# Columns that a table must offer before any view may read it.
REQUIRED_COLUMNS = {
    name: [field.name for field in schema if field.name not in ("payload_bytes",)]
    for name, schema in TABLE_SCHEMAS.items()
}

EVENT_TIME_COLUMN = {LOGS: "time_unix_nano", SPANS: "start_time_unix_nano", METRICS: "time_unix_nano"}


def missing_columns(signal: str, columns: list[str]) -> list[str]:
    """Names required for ``signal`` that ``columns`` lacks."""
    have = set(columns)
    return [name for name in REQUIRED_COLUMNS[signal] if name not in have]
