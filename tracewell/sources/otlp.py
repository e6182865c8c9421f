"""OTLP-JSON sources: one export request per text line, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.anyvalue import failure, normalize
from tracewell.model import LOGS, METRICS, SPANS

# Numbers are read as text: 64-bit integers arrive as JSON strings or numbers, and text
# keeps all of their digits. Nested values stay JSON text, see functions.anyvalue.
_ANY = (
    "struct<stringValue: string, boolValue: string, intValue: string, doubleValue: string,"
    " bytesValue: string, arrayValue: string, kvlistValue: string>"
)
_LIST = f"array<struct<key: string, value: {_ANY}>>"
_RESOURCE = f"struct<attributes: {_LIST}, droppedAttributesCount: string>"
_SCOPE = f"struct<name: string, version: string, attributes: {_LIST}, droppedAttributesCount: string>"
_EXEMPLARS = (
    f"array<struct<filteredAttributes: {_LIST}, timeUnixNano: string, asDouble: string, asInt: string,"
    " spanId: string, traceId: string>>"
)
_POINT = f"attributes: {_LIST}, startTimeUnixNano: string, timeUnixNano: string, flags: string"
_AGGREGATE = f"{_POINT}, count: string, sum: string, min: string, max: string, exemplars: {_EXEMPLARS}"

_LOG = (
    "struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: string,"
    f" severityText: string, eventName: string, body: {_ANY}, taggedBody: string, attributes: {_LIST},"
    " droppedAttributesCount: string, flags: string, traceId: string, spanId: string>"
)
_SPAN = (
    "struct<traceId: string, spanId: string, traceState: string, parentSpanId: string, flags: string,"
    " name: string, kind: string, startTimeUnixNano: string, endTimeUnixNano: string,"
    f" attributes: {_LIST}, droppedAttributesCount: string,"
    f" events: array<struct<timeUnixNano: string, name: string, attributes: {_LIST},"
    " droppedAttributesCount: string>>, droppedEventsCount: string,"
    f" links: array<struct<traceId: string, spanId: string, traceState: string, attributes: {_LIST},"
    " droppedAttributesCount: string, flags: string>>, droppedLinksCount: string,"
    " status: struct<message: string, code: string>>"
)
_METRIC = (
    f"struct<name: string, description: string, unit: string, metadata: {_LIST},"
    f" gauge: struct<dataPoints: array<struct<{_POINT}, asDouble: string, asInt: string,"
    f" exemplars: {_EXEMPLARS}>>>,"
    f" sum: struct<dataPoints: array<struct<{_POINT}, asDouble: string, asInt: string,"
    f" exemplars: {_EXEMPLARS}>>, aggregationTemporality: string, isMonotonic: string>,"
    f" histogram: struct<dataPoints: array<struct<{_AGGREGATE}, bucketCounts: array<string>,"
    " explicitBounds: array<string>>>, aggregationTemporality: string>,"
    f" exponentialHistogram: struct<dataPoints: array<struct<{_AGGREGATE}, scale: string, zeroCount: string,"
    " zeroThreshold: string, positive: struct<offset: string, bucketCounts: array<string>>,"
    " negative: struct<offset: string, bucketCounts: array<string>>>>, aggregationTemporality: string>,"
    f" summary: struct<dataPoints: array<struct<{_POINT}, count: string, sum: string,"
    " quantileValues: array<struct<quantile: string, value: string>>>>>>"
)

# Names of the nested lists in a request, by signal.
LAYOUT = {
    LOGS: ("resourceLogs", "scopeLogs", "logRecords", _LOG),
    SPANS: ("resourceSpans", "scopeSpans", "spans", _SPAN),
    METRICS: ("resourceMetrics", "scopeMetrics", "metrics", _METRIC),
}


def request_schema(signal: str) -> str:
    resources, scopes, records, record = LAYOUT[signal]
    return (
        f"struct<{resources}: array<struct<resource: {_RESOURCE}, schemaUrl: string,"
        f" {scopes}: array<struct<scope: {_SCOPE}, schemaUrl: string, {records}: array<{record}>>>>>,"
        " _corrupt: string>"
    )


def read_requests(spark: SparkSession, path: str, received_at: Column | None = None) -> DataFrame:
    """Requests from OTLP-JSON text files: request_key, received_at_unix_nano, value.

    The receipt time is the time at which the file appeared unless a column is given. It
    does not change when a lost task is run again, unlike the clock.
    """
    return _requests(spark.read.format("text").load(path), received_at)


def stream_requests(
    spark: SparkSession, path: str, received_at: Column | None = None, max_files_per_trigger: int = 1000
) -> DataFrame:
    """The streaming form of :func:`read_requests`: new files in ``path`` as they appear."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
    return _requests(reader.load(path), received_at)


def _requests(lines: DataFrame, received_at: Column | None) -> DataFrame:
    appeared = F.unix_micros("_metadata.file_modification_time") * 1000
    return lines.where(F.trim("value") != "").select(
        F.sha2(F.concat_ws("\n", "_metadata.file_path", "value"), 256).alias("request_key"),
        (appeared if received_at is None else received_at).cast("bigint").alias("received_at_unix_nano"),
        "value",
    )


def parse_requests(requests: DataFrame, signal: str) -> DataFrame:
    """Add ``parsed`` (typed request tree) and ``parse_error`` to each request."""
    options = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    prepared = requests.withColumn("_nested", normalize(F.col("value")))
    text = F.coalesce("_nested", "value")
    parsed = prepared.withColumn("parsed", F.from_json(text, request_schema(signal), options))
    malformed = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    error = F.coalesce(failure(F.col("_nested")), F.when(malformed, "malformed request"))
    return parsed.withColumn("parse_error", error).drop("_nested")
