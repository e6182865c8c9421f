"""Ingest: validate, redact, canonicalize, fingerprint and explode export requests.

A request stays one row until it is known to be valid as a whole, so the all-or-nothing
rule costs no shuffle. The steps are column expressions over the parsed request tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.attributes import is_sensitive, json_text
from tracewell.model import (
    LOGS,
    MAX_LOG_RECORDS,
    MAX_METRIC_POINTS,
    MAX_METRICS,
    MAX_PAYLOAD_BYTES,
    MAX_SPANS,
    MAX_VALUE_BYTES,
    METRIC_TYPES,
    METRICS,
    NUMBER_KINDS,
    REDACTED,
    SPANS,
    TABLE_SCHEMAS,
    UNKNOWN_SERVICE,
)
from tracewell.sources.otlp import LAYOUT, parse_requests


MALFORMED = "malformed request"


@dataclass(frozen=True)
class ContextKeys:
    """Attributes that become columns of their own."""

    service: str = "service.name"
    request: str = "request.id"
    product: str = "product.id"
    component: str = "app.component"
    event: str = "event.name"


# --- Text of values ------------------------------------------------------------------


def _object(fields: Iterable[tuple[str, Column]]) -> Column:
    """JSON object text of the fields whose text is not null."""
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(text: Column) -> Column:
    return F.when(text != "", json_text(text))


def _whole(text: Column) -> Column:
    """Unsigned 64-bit integer as canonical digits, null for zero."""
    number = text.try_cast("decimal(20,0)")
    return F.when(number != 0, number.cast("string"))


def _whole_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), _whole(text), F.lit('"'))


def _double(text: Column, positive: str = "Infinity") -> Column:
    number = text.try_cast("double")
    infinity = F.lit(float("inf"))
    return (
        F.when(F.isnan(number), F.lit('"NaN"'))
        .when(number == infinity, F.lit(f'"{positive}"'))
        .when(number == -infinity, F.lit('"-Infinity"'))
        .otherwise(number.cast("string"))
    )


def _signed(text: Column) -> Column:
    return F.concat(F.lit('"'), text.try_cast("bigint").cast("string"), F.lit('"'))


def _counts_list(items: Column) -> Column:
    zero = F.lit(0).cast("decimal(20,0)")
    digits = F.transform(items, lambda item: F.coalesce(item.try_cast("decimal(20,0)"), zero).cast("string"))
    return F.when(F.size(items) > 0, F.concat(F.lit('["'), F.array_join(digits, '","'), F.lit('"]')))


def _numbers_list(items: Column) -> Column:
    return F.when(
        F.size(items) > 0,
        F.concat(F.lit("["), F.array_join(F.transform(items, _double), ",", "0"), F.lit("]")),
    )


def value_text(value: Column) -> Column:
    """Canonical JSON of one attribute value."""

    def tag(name: str, text: Column) -> Column:
        return F.concat(F.lit('{"' + name + '":'), text, F.lit("}"))

    return F.coalesce(
        tag("stringValue", json_text(value["stringValue"])),
        tag("boolValue", value["boolValue"]),
        tag("intValue", _signed(value["intValue"])),
        tag("doubleValue", _double(value["doubleValue"])),
        tag("bytesValue", json_text(value["bytesValue"])),
        tag("arrayValue", value["arrayValue"]),
        tag("kvlistValue", value["kvlistValue"]),
        F.lit("{}"),
    )


def tagged_text(value: Column, nested: Column) -> Column:
    """A log body as ``{type: value}``; ``nested`` is the text of arrays and lists."""

    def tag(name: str, text: Column) -> Column:
        return F.concat(F.lit('{"' + name + '":'), text, F.lit("}"))

    return F.coalesce(
        nested,
        tag("string", json_text(value["stringValue"])),
        tag("bool", value["boolValue"]),
        tag("int", _signed(value["intValue"])),
        tag("double", _double(value["doubleValue"], "+Infinity")),
        tag("bytes", json_text(value["bytesValue"])),
        F.lit('{"empty":true}'),
    )


def attributes_text(attributes: Column) -> Column:
    """Redacted attribute list as JSON text, sorted by key; equal keys keep their order."""
    redacted = F.lit('{"stringValue":' + f'"{REDACTED}"' + "}")
    # The position makes the sort stable and the struct comparable without a lambda.
    entries = F.transform(
        attributes,
        lambda entry, position: F.struct(
            F.coalesce(entry["key"], F.lit("")).alias("key"),
            position.alias("position"),
            F.when(is_sensitive(entry["key"]), redacted).otherwise(value_text(entry["value"])).alias("text"),
        ),
    )
    listed = F.transform(
        F.sort_array(entries),
        lambda entry: F.concat(
            F.lit('{"key":'), json_text(entry["key"]), F.lit(',"value":'), entry["text"], F.lit("}")
        ),
    )
    return F.coalesce(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), F.lit("[]"))


def _optional(list_text: Column) -> Column:
    return F.when(list_text != "[]", list_text)


def string_attribute(attributes: Column, key: str) -> Column:
    """Value of the first attribute named ``key`` if it is a string, else null."""
    return F.get(F.filter(attributes, lambda entry: entry["key"] == key), 0)["value"]["stringValue"]


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def _hex_id(text: Column) -> Column:
    return F.when(~text.rlike("^0*$"), F.lower(text))


# --- Validation: each check is null or the reason ------------------------------------


def _attributes_error(attributes: Column, what: str) -> Column:
    limit = MAX_VALUE_BYTES
    tests = {
        f"{what} attributes: a key is larger than 1 MiB": lambda e: F.octet_length(e["key"]) > limit,
        f"{what} attributes: a string is larger than 1 MiB": lambda e: F.octet_length(e["value"]["stringValue"]) > limit,
        f"{what} attributes: a bytes value is larger than 1 MiB": lambda e: _bytes_length(e["value"]["bytesValue"]) > limit,
        MALFORMED: lambda e: _bad_scalar(e["value"]),
    }

    def holds(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda entry: F.coalesce(test(entry), F.lit(False))

    def reason(entry: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, test in reversed(tests.items()):
            found = F.when(holds(test)(entry), name).otherwise(found)
        return found

    # One pass finds out whether anything is wrong; only then is the reason looked up.
    wrong = F.exists(attributes, lambda e: _any([holds(test)(e) for test in tests.values()]))
    return F.when(wrong, _first_error(F.transform(attributes, reason)))


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found


def _bytes_length(text: Column) -> Column:
    padding = F.char_length(text) - F.char_length(F.rtrim(text, F.lit("=")))
    return F.floor(F.char_length(text) * 3 / 4) - padding


def _bad_scalar(value: Column) -> Column:
    return (
        (value["intValue"].isNotNull() & value["intValue"].try_cast("bigint").isNull())
        | (value["doubleValue"].isNotNull() & value["doubleValue"].try_cast("double").isNull())
        | F.coalesce(~value["boolValue"].isin("true", "false"), F.lit(False))
    )


def _any_attributes_error(items: Column, field: str, what: str) -> Column:
    return _first_error(F.transform(items, lambda item: _attributes_error(item[field], what)))


def _first_error(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda error: error.isNotNull()), 0)


def _time_error(what: str, *times: Column) -> Column:
    invalid = F.lit(False)
    for time in times:
        invalid = invalid | (time.isNotNull() & ~F.coalesce(time.try_cast("bigint") >= 0, F.lit(False)))
    return F.when(invalid, f"a {what} timestamp is not in 0..2^63-1")


def _numbers_error(**kinds: list[Column]) -> Column:
    """Malformed if a given text is no number of its type; what is not given has the default of the protocol."""
    wrong = F.lit(False)
    for kind, texts in kinds.items():
        for text in texts:
            wrong = wrong | (text.isNotNull() & text.try_cast(kind.replace("decimal", "decimal(20,0)")).isNull())
    return F.when(wrong, MALFORMED)


def _lists_error(*lists: Column) -> Column:
    """Malformed if an element of a list of counts is none."""
    wrong = F.lit(False)
    for items in lists:
        bad = F.exists(items, lambda x: x.isNull() | ~F.coalesce(x.try_cast("decimal(20,0)") >= 0, F.lit(False)))
        wrong = wrong | F.coalesce(bad, F.lit(False))
    return F.when(wrong, MALFORMED)


def _id_error(ids: list[tuple[Column, int]]) -> Column:
    invalid = F.lit(False)
    for text, digits in ids:
        invalid = invalid | F.coalesce(~text.rlike(rf"^([0-9a-fA-F]{{{digits}}})?\z"), F.lit(False))
    return F.when(invalid, MALFORMED)


def _time(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _code(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


# --- Errors of one record of each signal ---------------------------------------------


def _log_error(record: Column) -> Column:
    body = record["body"]
    large = F.coalesce(F.octet_length(body["stringValue"]) > MAX_VALUE_BYTES, F.lit(False)) | F.coalesce(
        _bytes_length(body["bytesValue"]) > MAX_VALUE_BYTES, F.lit(False)
    )
    return F.coalesce(
        _time_error("log", record["timeUnixNano"], record["observedTimeUnixNano"]),
        _numbers_error(int=[record["severityNumber"]], bigint=[record["flags"], record["droppedAttributesCount"]]),
        F.when(large, "a log body is larger than 1 MiB").when(
            F.coalesce(_bad_scalar(body), F.lit(False)), MALFORMED
        ),
        _attributes_error(record["attributes"], "log"),
        _id_error([(record["traceId"], 32), (record["spanId"], 16)]),
    )


def _span_error(span: Column) -> Column:
    missing = F.when(
        _hex_id(F.coalesce(span["traceId"], F.lit(""))).isNull()
        | _hex_id(F.coalesce(span["spanId"], F.lit(""))).isNull(),
        "a span has no trace_id or no span_id",
    )
    return F.coalesce(
        _time_error("span", span["startTimeUnixNano"], span["endTimeUnixNano"]),
        missing,
        _numbers_error(int=[span["kind"], span["status"]["code"]], bigint=[span["flags"], span["droppedAttributesCount"]]),
        _id_error([(span["traceId"], 32), (span["spanId"], 16), (span["parentSpanId"], 16)]),
        _attributes_error(span["attributes"], "span"),
        _any_attributes_error(span["events"], "attributes", "span event"),
        _any_attributes_error(span["links"], "attributes", "span link"),
    )


# The field that holds the data of each metric type.
_DATA_FIELD = {kind: kind for kind in METRIC_TYPES} | {"exponential_histogram": "exponentialHistogram"}


def metric_type(metric: Column) -> Column:
    """Which of the five data fields a metric has; null where it has none."""
    kind = F.lit(None).cast("string")
    for name in reversed(METRIC_TYPES):
        kind = F.when(metric[_DATA_FIELD[name]].isNotNull(), name).otherwise(kind)
    return kind


def point_count(metric: Column) -> Column:
    """Number of data points of a metric, whatever its type."""
    sizes = [F.size(metric[_DATA_FIELD[name]]["dataPoints"]) for name in METRIC_TYPES]
    return F.greatest(F.lit(0), *[F.coalesce(size, F.lit(0)) for size in sizes])


def _metric_error(metric: Column) -> Column:
    def point_error(kind: str) -> Callable[[Column], Column]:
        def error(p: Column) -> Column:
            errors = [_attributes_error(p["attributes"], "metric point")]
            if kind != "summary":
                errors.append(_any_attributes_error(p["exemplars"], "filteredAttributes", "metric exemplar"))
            errors.append(_time_error("metric", p["startTimeUnixNano"], p["timeUnixNano"]))
            errors.append(_numbers_error(bigint=[p["flags"]]))
            if kind not in ("gauge", "sum"):
                errors.append(_numbers_error(decimal=[p["count"]], double=[p["sum"]]))
            if kind == "histogram":
                errors.append(_lists_error(p["bucketCounts"]))
            if kind == "exponential_histogram":
                sides = [p["positive"], p["negative"]]
                errors.append(_numbers_error(int=[p["scale"], *[s["offset"] for s in sides]], decimal=[p["zeroCount"]]))
                errors.append(_lists_error(*[s["bucketCounts"] for s in sides]))
            if kind in ("gauge", "sum"):
                errors.append(F.when(p["asInt"].isNotNull() & p["asInt"].try_cast("bigint").isNull(), MALFORMED))
            return F.coalesce(*errors)

        return error

    return F.coalesce(
        F.when(metric_type(metric).isNull(), "a metric has no data"),
        _attributes_error(metric["metadata"], "metric metadata"),
        *[
            _first_error(F.transform(metric[_DATA_FIELD[kind]]["dataPoints"], point_error(kind)))
            for kind in METRIC_TYPES
        ],
    )


# --- Requests ------------------------------------------------------------------------

_LIMITS = {
    LOGS: (MAX_LOG_RECORDS, f"more than {MAX_LOG_RECORDS} log records in a request"),
    SPANS: (MAX_SPANS, f"more than {MAX_SPANS} spans in a request"),
    METRICS: (MAX_METRICS, f"more than {MAX_METRICS} metrics in a request"),
}
_WHAT = {LOGS: "log", SPANS: "span", METRICS: "metric"}
_RECORD_ERROR = {LOGS: _log_error, SPANS: _span_error, METRICS: _metric_error}


def build_requests(requests: DataFrame, signal: str) -> DataFrame:
    """Requests with their ``parsed`` tree and ``error``.

    ``error`` is the reason for which the whole request is refused, or null. The size of
    what would be stored is known only later, see :func:`oversized`.
    """
    resources, scopes, records_field, _ = LAYOUT[signal]
    what = _WHAT[signal]

    def scope_error(scope: Column) -> Column:
        return F.coalesce(
            _attributes_error(scope["scope"]["attributes"], f"{what} scope"),
            _first_error(F.transform(scope[records_field], _RECORD_ERROR[signal])),
        )

    def resource_error(resource: Column) -> Column:
        return F.coalesce(
            _attributes_error(resource["resource"]["attributes"], f"{what} resource"),
            _first_error(F.transform(resource[scopes], scope_error)),
        )

    def total(count: Callable[[Column], Column]) -> Column:
        def add(sum_so_far: Column, items: Column, one: Callable[[Column, Column], Column]) -> Column:
            return F.aggregate(F.coalesce(items, F.array()), sum_so_far, one)

        return add(
            F.lit(0),
            F.col("parsed")[resources],
            lambda t, r: add(t, r[scopes], lambda u, s: u + count(s[records_field])),
        )

    parsed = parse_requests(requests, signal)
    limit, limit_reason = _LIMITS[signal]
    errors = [
        F.col("parse_error"),
        F.when(total(lambda items: F.greatest(F.size(items), F.lit(0))) > limit, limit_reason),
        _first_error(F.transform(F.col("parsed")[resources], resource_error)),
    ]
    if signal == METRICS:
        points = total(
            lambda items: F.aggregate(F.coalesce(items, F.array()), F.lit(0), lambda t, m: t + point_count(m))
        )
        errors.insert(2, F.when(points > MAX_METRIC_POINTS, "metric request exceeds 10000 points"))
    return parsed.select("request_key", "received_at_unix_nano", "parsed", F.coalesce(*errors).alias("error"))


def rejected(built: DataFrame) -> DataFrame:
    """Refused requests with the reason. Their text may hold credentials and is left out."""
    # A filter on the generated column stays above it; a filter on ``error`` itself would
    # be pushed down and the whole check evaluated twice.
    reasons = built.select(
        "request_key", "received_at_unix_nano", F.explode_outer(F.array("error")).alias("reason")
    )
    return reasons.where(F.col("reason").isNotNull())


def oversized(rows: DataFrame) -> DataFrame:
    """Keys of requests whose records together exceed the stored size of one request."""
    return (
        rows.groupBy("request_key")
        .agg(F.sum("payload_bytes").alias("_bytes"))
        .where(F.col("_bytes") > MAX_PAYLOAD_BYTES)
        .select("request_key")
    )


def records(built: DataFrame, signal: str) -> DataFrame:
    """Rows of the signal table, without ``id``, from the valid requests.

    ``request_key`` and ``position`` tell where in its request a record stood.
    """
    return _enveloped(built, signal, ContextKeys(), False).drop("reason")


def outcome(built: DataFrame, signal: str, keys: ContextKeys = ContextKeys()) -> DataFrame:
    """Records of valid requests and one row with ``reason`` per refused one, in one pass."""
    return _enveloped(built, signal, keys, True)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _enveloped(built: DataFrame, signal: str, keys: ContextKeys, with_refused: bool) -> DataFrame:
    """One row per record: resource, scope and record are opened one after the other.

    What belongs to a resource or scope is worked out once per resource or scope, before
    its records are opened.
    """
    resources, scopes, records_field, _ = LAYOUT[signal]
    carried = ["request_key", "received_at_unix_nano", "reason"]
    by_resource = built.select(
        "request_key",
        "received_at_unix_nano",
        F.col("error").alias("reason"),
        F.posexplode_outer(F.when(F.col("error").isNull(), F.col("parsed")[resources])).alias("_r", "_resource"),
    )
    resource = F.col("_resource.resource")
    by_resource = by_resource.select(
        *carried,
        "_r",
        F.col(f"_resource.{scopes}").alias("_scopes"),
        _text(F.col("_resource.schemaUrl")).alias("resource_schema_url"),
        attributes_text(resource["attributes"]).alias("resource_attributes"),
        _whole(resource["droppedAttributesCount"]).alias("_resource_dropped"),
        F.coalesce(_nonempty(string_attribute(resource["attributes"], keys.service)), F.lit(UNKNOWN_SERVICE)).alias(
            "service_name"
        ),
    )
    carried += ["_r", "resource_schema_url", "resource_attributes", "_resource_dropped", "service_name"]
    by_scope = by_resource.select(*carried, F.posexplode_outer("_scopes").alias("_s", "_scope"))
    scope = F.col("_scope.scope")
    by_scope = by_scope.select(
        *carried,
        "_s",
        F.col(f"_scope.{records_field}").alias("_records"),
        _text(F.col("_scope.schemaUrl")).alias("scope_schema_url"),
        attributes_text(scope["attributes"]).alias("scope_attributes"),
        _whole(scope["droppedAttributesCount"]).alias("_scope_dropped"),
        _text(scope["name"]).alias("scope_name"),
        _text(scope["version"]).alias("scope_version"),
    )
    carried += ["_s", "scope_schema_url", "scope_attributes", "_scope_dropped", "scope_name", "scope_version"]
    opened = by_scope.select(*carried, F.posexplode_outer("_records").alias("_i", "_record"))
    if signal == METRICS:
        opened = _metric_points(opened, carried)
        carried += ["_i", *_METRIC_COLUMNS]
    found = F.col("_point" if signal == METRICS else "_record").isNotNull()
    opened = opened.where((found | F.col("reason").isNotNull()) if with_refused else found)

    one = {LOGS: _log_columns, SPANS: _span_columns, METRICS: _point_columns}[signal]
    record = F.col("_point" if signal == METRICS else "_record")
    texts, record_json = one(record, keys)
    marks = ["_r", "_s", "_i", "_p"] if signal == METRICS else ["_r", "_s", "_i"]
    kept = [name for name in [*carried, *marks] if name not in marks]
    rows = opened.select(*kept, F.array(*[F.col(m).cast("bigint") for m in marks]).alias("position"), *texts)
    rows = rows.withColumn("payload_json", _envelope(signal, record_json))

    size = F.octet_length("payload_json")
    if signal == LOGS:
        size = size + F.octet_length("body_json")
    rows = rows.withColumns(
        {"fingerprint": F.sha2("payload_json", 256), "payload_bytes": size.cast("bigint")}
    )
    columns = [
        F.col(field.name).cast(field.dataType).alias(field.name)
        for field in TABLE_SCHEMAS[signal]
        if field.name in rows.columns and field.name != "received_at_unix_nano"
    ]
    return rows.select("request_key", "position", "received_at_unix_nano", "reason", *columns)


def _envelope(signal: str, record_json: Column) -> Column:
    """The single-record request that is stored and fingerprinted."""
    resources, scopes, records_field, _ = LAYOUT[signal]
    resource = _object(
        [("attributes", _optional(F.col("resource_attributes"))), ("droppedAttributesCount", F.col("_resource_dropped"))]
    )
    scope = _object(
        [
            ("attributes", _optional(F.col("scope_attributes"))),
            ("droppedAttributesCount", F.col("_scope_dropped")),
            ("name", _quoted(F.col("scope_name"))),
            ("version", _quoted(F.col("scope_version"))),
        ]
    )

    def only(item: Column) -> Column:
        return F.concat(F.lit("["), item, F.lit("]"))

    scoped = _object(
        [(records_field, only(record_json)), ("schemaUrl", _quoted(F.col("scope_schema_url"))), ("scope", scope)]
    )
    whole = _object(
        [("resource", resource), ("schemaUrl", _quoted(F.col("resource_schema_url"))), (scopes, only(scoped))]
    )
    return _object([(resources, only(whole))])


# --- Columns of one record: (columns, canonical JSON made from them) -------------------


def _log_columns(record: Column, keys: ContextKeys) -> tuple[list[Column], Column]:
    attributes = record["attributes"]
    observed = record["observedTimeUnixNano"].try_cast("bigint")
    body = value_text(record["body"])
    columns = [
        _time(record["timeUnixNano"]).alias("time_unix_nano"),
        _code(record["severityNumber"]).alias("severity_number"),
        _text(record["severityText"]).alias("severity_text"),
        _hex_id(record["traceId"]).alias("trace_id"),
        _hex_id(record["spanId"]).alias("span_id"),
        _nonempty(string_attribute(attributes, keys.request)).alias("request_id"),
        _nonempty(string_attribute(attributes, keys.product)).alias("product_id"),
        _nonempty(string_attribute(attributes, keys.component)).alias("component"),
        F.coalesce(
            _nonempty(string_attribute(attributes, keys.event)), _nonempty(record["eventName"])
        ).alias("op"),
        tagged_text(record["body"], record["taggedBody"]).alias("body_json"),
        attributes_text(attributes).alias("attributes"),
        _text(record["eventName"]).alias("event_name"),
        F.when(observed != 0, observed).alias("observed_time"),
        F.coalesce(record["flags"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("flags"),
        F.when(body != "{}", body).alias("_body"),
        _whole(record["droppedAttributesCount"]).alias("_dropped"),
        _whole_quoted(record["observedTimeUnixNano"]).alias("_observed"),
        _whole_quoted(record["timeUnixNano"]).alias("_time"),
        _whole(record["flags"]).alias("_flags"),
    ]
    text = _object(
        [
            ("attributes", _optional(F.col("attributes"))),
            ("body", F.col("_body")),
            ("droppedAttributesCount", F.col("_dropped")),
            ("eventName", _quoted(F.col("event_name"))),
            ("flags", F.col("_flags")),
            ("observedTimeUnixNano", F.col("_observed")),
            ("severityNumber", _digits("severity_number")),
            ("severityText", _quoted(F.col("severity_text"))),
            ("spanId", _quoted(F.col("span_id"))),
            ("timeUnixNano", F.col("_time")),
            ("traceId", _quoted(F.col("trace_id"))),
        ]
    )
    return columns, text


def _digits(name: str) -> Column:
    return F.when(F.col(name) != 0, F.col(name).cast("string"))


def _span_columns(span: Column, keys: ContextKeys) -> tuple[list[Column], Column]:
    attributes = span["attributes"]

    def event(item: Column) -> Column:
        return _object(
            [
                ("attributes", _optional(attributes_text(item["attributes"]))),
                ("droppedAttributesCount", _whole(item["droppedAttributesCount"])),
                ("name", _quoted(item["name"])),
                ("timeUnixNano", _whole_quoted(item["timeUnixNano"])),
            ]
        )

    def link(item: Column) -> Column:
        return _object(
            [
                ("attributes", _optional(attributes_text(item["attributes"]))),
                ("droppedAttributesCount", _whole(item["droppedAttributesCount"])),
                ("flags", _whole(item["flags"])),
                ("spanId", _quoted(_hex_id(item["spanId"]))),
                ("traceId", _quoted(_hex_id(item["traceId"]))),
                ("traceState", _quoted(item["traceState"])),
            ]
        )

    columns = [
        _hex_id(span["traceId"]).alias("trace_id"),
        _hex_id(span["spanId"]).alias("span_id"),
        _hex_id(span["parentSpanId"]).alias("parent_span_id"),
        _text(span["name"]).alias("name"),
        _time(span["startTimeUnixNano"]).alias("start_time_unix_nano"),
        _time(span["endTimeUnixNano"]).alias("end_time_unix_nano"),
        _nonempty(string_attribute(attributes, keys.request)).alias("request_id"),
        _nonempty(string_attribute(attributes, keys.product)).alias("product_id"),
        attributes_text(attributes).alias("attributes"),
        _code(span["kind"]).alias("kind"),
        _code(span["status"]["code"]).alias("status_code"),
        _text(span["status"]["message"]).alias("status_message"),
        _object_list(span["events"], event).alias("events"),
        _object_list(span["links"], link).alias("links"),
        _whole(span["droppedAttributesCount"]).alias("_dropped"),
        _whole(span["droppedEventsCount"]).alias("_dropped_events"),
        _whole(span["droppedLinksCount"]).alias("_dropped_links"),
        _whole(span["flags"]).alias("_flags"),
        _text(span["traceState"]).alias("_trace_state"),
    ]
    status = _object([("code", _digits("status_code")), ("message", _quoted(F.col("status_message")))])
    nanos = lambda name: F.concat(F.lit('"'), _digits(name), F.lit('"'))
    text = _object(
        [
            ("attributes", _optional(F.col("attributes"))),
            ("droppedAttributesCount", F.col("_dropped")),
            ("droppedEventsCount", F.col("_dropped_events")),
            ("droppedLinksCount", F.col("_dropped_links")),
            ("endTimeUnixNano", nanos("end_time_unix_nano")),
            ("events", _optional(F.col("events"))),
            ("flags", F.col("_flags")),
            ("kind", _digits("kind")),
            ("links", _optional(F.col("links"))),
            ("name", _quoted(F.col("name"))),
            ("parentSpanId", _quoted(F.col("parent_span_id"))),
            ("spanId", _quoted(F.col("span_id"))),
            ("startTimeUnixNano", nanos("start_time_unix_nano")),
            ("status", F.when((F.col("status_code") != 0) | (F.col("status_message") != ""), status)),
            ("traceId", _quoted(F.col("trace_id"))),
            ("traceState", _quoted(F.col("_trace_state"))),
        ]
    )
    return columns, text


def _object_list(items: Column, text: Callable[[Column], Column]) -> Column:
    joined = F.array_join(F.transform(items, text), ",")
    return F.coalesce(F.concat(F.lit("["), joined, F.lit("]")), F.lit("[]"))


def finite(number: Column) -> Column:
    """The number, or null where it is not finite."""
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def temporality_name(kind: Column, code: Column) -> Column:
    """Gauges and summaries have no temporality; unknown codes count as unspecified."""
    return (
        F.when(kind.isin("gauge", "summary"), "unspecified")
        .when(code == 1, "delta")
        .when(code == 2, "cumulative")
        .otherwise("unspecified")
    )


_METRIC_COLUMNS = [
    "metric_name",
    "metric_type",
    "description",
    "unit",
    "temporality",
    "monotonic",
    "_metadata_text",
    "_temporality_code",
]

# Fields of a data point by the metric types that have them; all are read as one struct.
_NUMBER_FIELDS = {"asDouble": "string", "asInt": "string"}
_TOTAL_FIELDS = {"count": "string", "sum": "string"}
_RANGE_FIELDS = {"min": "string", "max": "string"}
_HISTOGRAM_FIELDS = {"bucketCounts": "array<string>", "explicitBounds": "array<string>"}
_SIDE = "struct<offset: string, bucketCounts: array<string>>"
_EXPONENTIAL_FIELDS = {
    "scale": "string",
    "zeroCount": "string",
    "zeroThreshold": "string",
    "positive": _SIDE,
    "negative": _SIDE,
}
_SUMMARY_FIELDS = {"quantileValues": "array<struct<quantile: string, value: string>>"}
_FIELDS_OF = {
    "gauge": _NUMBER_FIELDS,
    "sum": _NUMBER_FIELDS,
    "histogram": _TOTAL_FIELDS | _RANGE_FIELDS | _HISTOGRAM_FIELDS,
    "exponential_histogram": _TOTAL_FIELDS | _RANGE_FIELDS | _EXPONENTIAL_FIELDS,
    "summary": _TOTAL_FIELDS | _SUMMARY_FIELDS,
}
_ALL_FIELDS = (
    _NUMBER_FIELDS | _TOTAL_FIELDS | _RANGE_FIELDS | _HISTOGRAM_FIELDS | _EXPONENTIAL_FIELDS | _SUMMARY_FIELDS
)


def _metric_points(opened: DataFrame, carried: list[str]) -> DataFrame:
    """Open the points of each metric; ``_point`` has the fields of all types."""
    metric = F.col("_record")
    exemplars = opened.schema["_record"].dataType["gauge"].dataType["dataPoints"].dataType.elementType["exemplars"]

    def common(kind: str) -> Column:
        def point(p: Column) -> Column:
            fields = [p[name] for name in ("attributes", "startTimeUnixNano", "timeUnixNano", "flags")]
            none = F.lit(None).cast(exemplars.dataType)
            fields.append((none if kind == "summary" else p["exemplars"]).alias("exemplars"))
            for name, spark_type in _ALL_FIELDS.items():
                present = name in _FIELDS_OF[kind]
                fields.append((p[name] if present else F.lit(None).cast(spark_type)).alias(name))
            return F.struct(*fields)

        return F.transform(metric[_DATA_FIELD[kind]]["dataPoints"], point)

    code = F.coalesce(
        metric["sum"]["aggregationTemporality"],
        metric["histogram"]["aggregationTemporality"],
        metric["exponentialHistogram"]["aggregationTemporality"],
    ).try_cast("int")
    kind = metric_type(metric)
    monotonic = F.coalesce(metric["sum"]["isMonotonic"] == "true", F.lit(False)).cast("int")
    heads = opened.select(
        *carried,
        "_i",
        _text(metric["name"]).alias("metric_name"),
        kind.alias("metric_type"),
        _text(metric["description"]).alias("description"),
        _text(metric["unit"]).alias("unit"),
        temporality_name(kind, code).alias("temporality"),
        F.when(kind == "sum", monotonic).alias("monotonic"),
        attributes_text(metric["metadata"]).alias("_metadata_text"),
        F.when(code != 0, code.cast("string")).alias("_temporality_code"),
        F.coalesce(*[common(name) for name in METRIC_TYPES]).alias("_points"),
    )
    return heads.select(*carried, "_i", *_METRIC_COLUMNS, F.posexplode_outer("_points").alias("_p", "_point"))


def _point_columns(p: Column, keys: ContextKeys) -> tuple[list[Column], Column]:
    kind = F.col("metric_type")
    number = kind.isin("gauge", "sum")

    def exemplar(item: Column) -> Column:
        return _object(
            [
                ("asDouble", F.when(item["asInt"].isNull(), _double(item["asDouble"]))),
                ("asInt", _signed(item["asInt"])),
                ("filteredAttributes", _optional(attributes_text(item["filteredAttributes"]))),
                ("spanId", _quoted(_hex_id(item["spanId"]))),
                ("timeUnixNano", _whole_quoted(item["timeUnixNano"])),
                ("traceId", _quoted(_hex_id(item["traceId"]))),
            ]
        )

    def side(buckets: Column) -> Column:
        text = _object(
            [("bucketCounts", _counts_list(buckets["bucketCounts"])), ("offset", _nonzero(buckets["offset"]))]
        )
        return F.when(buckets.isNotNull() & (text != "{}"), text)

    quantiles = _object_list(
        p["quantileValues"],
        lambda q: _object([("quantile", _double(q["quantile"])), ("value", _double(q["value"]))]),
    )
    # Protocol defaults: a missing count is 0, and a summary always has a sum.
    total = F.coalesce(p["sum"].try_cast("double"), F.when(kind == "summary", F.lit(0.0)))
    columns = [
        _time(p["startTimeUnixNano"]).alias("start_time_unix_nano"),
        _time(p["timeUnixNano"]).alias("time_unix_nano"),
        F.when(p["asInt"].isNotNull(), NUMBER_KINDS[0])
        .when(p["asDouble"].isNotNull(), NUMBER_KINDS[1])
        .alias("number_kind"),
        p["asInt"].try_cast("bigint").alias("number_int"),
        F.when(p["asInt"].isNull(), finite(p["asDouble"].try_cast("double"))).alias("number_double"),
        F.when(~number, F.coalesce(_whole(p["count"]), F.lit("0"))).alias("aggregate_count"),
        F.when(~number, finite(total)).alias("aggregate_sum"),
        finite(p["min"].try_cast("double")).alias("aggregate_min"),
        finite(p["max"].try_cast("double")).alias("aggregate_max"),
        attributes_text(p["attributes"]).alias("attributes"),
        F.coalesce(p["flags"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("flags"),
        _object_list(p["exemplars"], exemplar).alias("exemplars"),
        F.coalesce(_counts_list(p["bucketCounts"]), F.lit("[]")).alias("bucket_counts"),
        F.coalesce(_numbers_list(p["explicitBounds"]), F.lit("[]")).alias("explicit_bounds"),
        F.nullif(p["scale"].try_cast("int"), F.lit(0)).alias("scale"),
        _whole(p["zeroCount"]).alias("zero_count"),
        F.nullif(p["zeroThreshold"].try_cast("double"), F.lit(0.0)).alias("zero_threshold"),
        side(p["positive"]).alias("positive"),
        side(p["negative"]).alias("negative"),
        quantiles.alias("quantile_values"),
        F.when(p["asInt"].isNull(), _double(p["asDouble"])).alias("_as_double"),
        _double(p["sum"]).alias("_sum"),
        _double(p["min"]).alias("_min"),
        _double(p["max"]).alias("_max"),
    ]
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    point = _object(
        [
            ("asDouble", F.col("_as_double")),
            ("asInt", quoted(F.col("number_int").cast("string"))),
            ("attributes", _optional(F.col("attributes"))),
            ("bucketCounts", _optional(F.col("bucket_counts"))),
            ("count", quoted(F.nullif(F.col("aggregate_count"), F.lit("0")))),
            ("exemplars", _optional(F.col("exemplars"))),
            ("explicitBounds", _optional(F.col("explicit_bounds"))),
            ("flags", _digits("flags")),
            ("max", F.col("_max")),
            ("min", F.col("_min")),
            ("negative", F.col("negative")),
            ("positive", F.col("positive")),
            ("quantileValues", _optional(F.col("quantile_values"))),
            ("scale", F.col("scale").cast("string")),
            ("startTimeUnixNano", quoted(_digits("start_time_unix_nano"))),
            ("sum", F.col("_sum")),
            ("timeUnixNano", quoted(_digits("time_unix_nano"))),
            ("zeroCount", quoted(F.col("zero_count"))),
            ("zeroThreshold", F.col("zero_threshold").cast("string")),
        ]
    )
    data = _object(
        [
            ("aggregationTemporality", F.col("_temporality_code")),
            ("dataPoints", F.concat(F.lit("["), point, F.lit("]"))),
            ("isMonotonic", F.when(F.col("monotonic") == 1, F.lit("true"))),
        ]
    )
    data_field = F.when(kind == "exponential_histogram", "exponentialHistogram").otherwise(kind)
    metric = F.concat_ws(
        ",",
        F.concat(F.lit('{"description":'), _quoted(F.col("description"))),
        F.concat(F.when(F.col("description") == "", "{").otherwise(""), F.lit('"'), data_field, F.lit('":'), data),
        F.concat(F.lit('"metadata":'), _optional(F.col("_metadata_text"))),
        F.concat(F.lit('"name":'), _quoted(F.col("metric_name"))),
        F.concat(F.lit('"unit":'), _quoted(F.col("unit"))),
    )
    return columns, F.concat(metric, F.lit("}"))


def _nonzero(text: Column) -> Column:
    number = text.try_cast("bigint")
    return F.when(number != 0, number.cast("string"))


def storable(signal: str) -> Column:
    """Last check before a row may be stored."""
    valid = F.col("payload_json").isNotNull() & F.col("fingerprint").isNotNull()
    if signal == METRICS:
        valid = (
            valid
            & F.col("metric_type").isin(METRIC_TYPES)
            & (F.col("number_kind").isNull() | F.col("number_kind").isin(NUMBER_KINDS))
        )
    return valid
