"""Telemetry derived row by row from the given tables.

Every derivation is a narrow projection of its source (spans add one equi-join), so the
telemetry grows with the tables and costs no extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000_000
TEN_DAYS = 864_000 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Names a folder that holds the derived tables as Parquet; unset, they are derived on the fly.
PREPARED = "spark.tracewell.prepared"


def prepared(function):
    """Read a derived table from the prepared folder of the session, if there is one."""

    def read(spark: SparkSession, sf_dir: str, *options) -> DataFrame:
        folder = spark.conf.get(PREPARED, None)
        if folder and not options:
            return spark.read.parquet(f"{folder}/{function.__name__}")
        return function(spark, sf_dir, *options)

    read.__doc__ = function.__doc__
    return read


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number), width, "0"))


def _text(*parts) -> Column:
    return F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in parts])


def string_attribute(key: str, value) -> Column:
    return _text('{"key":"' + key + '","value":{"stringValue":"', value, '"}}')


def int_attribute(key: str, value) -> Column:
    return _text('{"key":"' + key + '","value":{"intValue":"', value.cast("string"), '"}}')


def attribute_list(*entries: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *entries), F.lit("]"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the expressions that the telemetry tables share."""
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        nanos("ts").alias("ns"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").alias("k"),
        (nanos("ts") + F.pmod(event, F.lit(7)) * SECOND).alias("received_at_unix_nano"),
        F.when(user % 10 == 9, "unknown_service")
        .otherwise(_text("svc-", (user % 5).cast("string")))
        .alias("service_name"),
    )


def _context(instance: Column) -> dict[str, Column]:
    user = F.col("user_id")
    name = F.when(F.col("service_name") != "unknown_service", string_attribute("service.name", F.col("service_name")))
    return {
        "resource_attributes": attribute_list(int_attribute("host.slot", instance), name),
        "resource_schema_url": F.when(user % 2 == 0, "https://schemas.test/1.0").otherwise(""),
        "scope_name": F.lit("shop"),
        "scope_version": _text("1.", (user % 2).cast("string")),
        "scope_attributes": F.lit("[]"),
        "scope_schema_url": F.lit(""),
    }


def _log_columns() -> dict[str, Column]:
    """The columns of the log of an event."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    severity = (
        F.when(kind == "error", 17).when(kind == "purchase", 13).when(kind == "signup", 9).when(kind == "click", 5)
    ).otherwise(1)
    return {
        "id": event,
        "received_at_unix_nano": F.col("received_at_unix_nano"),
        "time_unix_nano": F.when(event % 50 == 0, 0).otherwise(F.col("ns")).cast("bigint"),
        "service_name": F.col("service_name"),
        "severity_number": severity.cast("int"),
        "severity_text": kind,
        "trace_id": F.when(event % 3 != 0, _hex(event % 200 + 1, 32)),
        "span_id": F.when(event % 6 == 1, _hex(event * 8 + 2, 16)),
        "body_json": _text('{"string":"', kind, " by user ", user.cast("string"), '"}'),
        **_context(user % 3),
        "attributes": attribute_list(
            string_attribute("api_key", "[REDACTED]"),
            string_attribute("event.type", kind),
            int_attribute("k", F.col("k")),
        ),
        "event_name": F.when(kind == "signup", "user.signup").otherwise(""),
        "observed_time": F.col("received_at_unix_nano"),
        "flags": event % 2,
    }


@prepared
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per event."""
    return events(spark, sf_dir).select(*[column.alias(name) for name, column in _log_columns().items()])


@prepared
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per line item, started when its order was placed."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", nanos("l_shipdate").alias("shipped"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), nanos("o_orderdate").alias("ordered"), "o_orderpriority"
    )
    order, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    service = _text("svc-", (supplier % 5).cast("string"))
    identity = F.concat_ws(
        "|", order, line, "l_partkey", supplier,
        F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.round(F.col("l_quantity")).cast("bigint"),
    )
    status = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return lines.join(orders, "l_orderkey").select(
        F.conv(F.substring(F.md5(identity), 1, 15), 16, 10).cast("bigint").alias("id"),
        F.sha2(identity, 256).alias("fingerprint"),
        (F.col("ordered") + (line % 3).cast("bigint") * SECOND).alias("received_at_unix_nano"),
        _hex(order % 200 + 1, 32).alias("trace_id"),
        _hex(order * 8 + line + 1, 16).alias("span_id"),
        F.when(line != 1, _hex(order * 8 + 2, 16)).alias("parent_span_id"),
        service.alias("service_name"),
        _text("ship part ", (F.col("l_partkey") % 20).cast("string")).alias("name"),
        (line % 6).alias("kind"),
        status.cast("int").alias("status_code"),
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("").alias("status_message"),
        F.when(line == 7, 0).otherwise(F.col("ordered")).cast("bigint").alias("start_time_unix_nano"),
        F.col("shipped").alias("end_time_unix_nano"),
        attribute_list(string_attribute("service.name", service)).alias("resource_attributes"),
        F.lit("").alias("resource_schema_url"),
        F.lit("shipping").alias("scope_name"),
        F.lit("2.0").alias("scope_version"),
        F.lit("[]").alias("scope_attributes"),
        F.lit("").alias("scope_schema_url"),
        attribute_list(
            _text('{"key":"line.open","value":{"boolValue":', F.when(F.col("l_linestatus") == "O", "true").otherwise("false"), "}}"),
            string_attribute("order.priority", F.col("o_orderpriority")),
            int_attribute("quantity", F.round(F.col("l_quantity")).cast("bigint")),
        ).alias("attributes"),
        F.lit("[]").alias("events"),
        F.lit("[]").alias("links"),
    )


@prepared
def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event, plus a second point at the same time for every 71st event."""
    event, user, kind, ns = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("ns")
    slot = user % 4
    view = lambda number: (kind == "view") & (slot == number)
    base = events(spark, sf_dir).select(
        "*",
        F.when(kind == "error", "gauge")
        .when(view(0), "histogram")
        .when(view(1), "exponential_histogram")
        .when(view(2), "summary")
        .otherwise("sum")
        .alias("metric_type"),
        (ns - ns % TEN_DAYS).alias("bucket"),
        F.explode(
            F.when(event % 71 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ).alias("copy"),
    )
    kindof = F.col("metric_type")
    number = kindof.isin("gauge", "sum")
    temporality = (
        F.when(kindof.isin("gauge", "summary") | (user % 25 == 0), "unspecified")
        .when(kind == "click", "delta")
        .otherwise("cumulative")
    )
    # A counter that follows the clock, with a step back at some events.
    counter = F.call_function("div", ns - F.col("bucket"), F.lit(10_000_000)) * (1 + user % 3) - F.when(
        event % 29 == 0, F.lit(50_000_000)
    ).otherwise(F.lit(0))
    value = (
        F.when(event % 43 == 0, F.lit(None).cast("bigint"))
        .when(event % 61 == 0, F.lit(-1))
        .when(event % 67 == 0, F.lit(0))
        .when(kind == "click", F.col("cents"))
        .otherwise(F.greatest(counter, F.lit(0)))
    ) + F.col("copy")
    # Some delta intervals overlap the point before, others leave a gap.
    length = F.when(event % 5 == 0, 90_000).when(event % 7 == 0, 1).otherwise(3_600) * F.lit(SECOND).cast("bigint")
    start = (
        F.when(event % 47 == 0, F.lit(0))
        .when(event % 53 == 0, ns)
        .when(event % 59 == 0, ns + 1)
        .when(kind == "click", ns - length)
        .otherwise(F.col("bucket") - SECOND)
    )
    histogram = kindof.isin("histogram", "exponential_histogram")
    trace, span = _hex(event % 200 + 1, 32), _hex(event * 8 + 2, 16)
    exemplar = _text(
        '[{"asInt":"', F.col("cents").cast("string"), '","filteredAttributes":[],"spanId":"', span,
        '","timeUnixNano":"', ns.cast("string"), '","traceId":"', trace, '"}]',
    )
    context = _context(user % 3)
    return base.select(
        (event + F.col("copy") * 100_000_000_000).alias("id"),
        "received_at_unix_nano",
        "service_name",
        *[column.alias(name) for name, column in context.items()],
        _text("shop.", kind).alias("metric_name"),
        "metric_type",
        F.when(kind == "purchase", "By").otherwise("1").alias("unit"),
        temporality.alias("temporality"),
        F.when(kindof == "sum", F.when(kind == "view", 0).otherwise(1)).cast("int").alias("monotonic"),
        attribute_list(
            string_attribute("event.type", kind), int_attribute("user", user)
        ).alias("attributes"),
        F.when(event % 2 == 0, "even").otherwise("odd").alias("description"),
        F.when(event % 41 == 0, 1).otherwise(0).cast("bigint").alias("flags"),
        F.when(number & value.isNotNull(), F.when(user % 2 == 0, "int").otherwise("double")).alias("number_kind"),
        F.when(number & (user % 2 == 0), value).cast("bigint").alias("number_int"),
        F.when(number & (user % 2 == 1), value.cast("double") / 4).alias("number_double"),
        F.when(~number, F.col("k")).alias("aggregate_count"),
        F.when(~number, F.col("value")).alias("aggregate_sum"),
        F.when(histogram, F.lit(0.01)).alias("aggregate_min"),
        F.when(histogram, F.col("value")).alias("aggregate_max"),
        ns.alias("time_unix_nano"),
        start.cast("bigint").alias("start_time_unix_nano"),
        F.when(kindof == "histogram", _text('["', F.col("k"), '","0"]')).otherwise("[]").alias("bucket_counts"),
        F.when(kindof == "histogram", F.lit("[100.0]")).otherwise("[]").alias("explicit_bounds"),
        F.when(kindof == "exponential_histogram", F.lit(2)).cast("int").alias("scale"),
        F.when(kindof == "exponential_histogram", F.col("k")).alias("zero_count"),
        F.lit(None).cast("double").alias("zero_threshold"),
        F.lit(None).cast("string").alias("positive"),
        F.lit(None).cast("string").alias("negative"),
        F.when(kindof == "summary", F.lit('[{"quantile":0.5,"value":1.5}]')).otherwise("[]").alias("quantile_values"),
        F.when((event % 10 == 0) & (kindof != "summary"), exemplar).otherwise("[]").alias("exemplars"),
    )


# --- Export requests ------------------------------------------------------------------

PER_REQUEST = 50  # events per request; bounds every request group


def _field(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), text)


def _json_object(*fields: Column) -> Column:
    """JSON object from field texts; null fields are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _quoted(column: Column) -> Column:
    return _text('"', column.cast("string"), '"')


def _requests(elements: DataFrame, root: str) -> DataFrame:
    """Groups of up to 50 elements (event_id, received, text) as one request each."""
    chunk = F.call_function("div", F.col("event_id"), F.lit(PER_REQUEST))
    return (
        elements.groupBy(chunk.alias("chunk"))
        .agg(
            F.min("received").alias("received_at_unix_nano"),
            F.sort_array(F.collect_list(F.struct("event_id", "part", "text"))).alias("items"),
        )
        .select(
            F.lpad(F.col("chunk").cast("string"), 12, "0").alias("request_key"),
            "received_at_unix_nano",
            _text('{"' + root + '":[', F.array_join(F.col("items.text"), ","), "]}").alias("value"),
        )
    )


@prepared
def log_requests(spark: SparkSession, sf_dir: str, reverse_attributes: bool = False) -> DataFrame:
    """The logs as OTLP-JSON requests with credentials, nested bodies and invalid times."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    # The columns of the logs stand next to those of the events they are made of, so nothing is joined.
    logged = ["time_unix_nano", "severity_number", "trace_id", "span_id", "event_name", "resource_schema_url", "scope_version"]
    columns = _log_columns()
    source = events(spark, sf_dir).withColumns({name: columns[name] for name in logged})
    said = _text(kind, " by user ", user.cast("string"))
    body = F.when(
        event % 10 == 0,
        _text(
            '{"kvlistValue":{"values":[{"key":"password","value":{"stringValue":"p', event.cast("string"),
            '"}},{"key":"message","value":{"stringValue":"', said, '"}}]}}',
        ),
    ).otherwise(_text('{"stringValue":"', said, '"}'))
    chunk = F.call_function("div", event, F.lit(PER_REQUEST))
    time = F.when(
        (event % PER_REQUEST == 0) & (chunk % 17 == 3), F.lit('"9223372036854775808"')
    ).otherwise(_quoted(F.col("time_unix_nano")))
    attributes = [
        int_attribute("k", F.col("k")),
        string_attribute("event.type", kind),
        string_attribute("api_key", _text("secret-", event.cast("string"))),
    ]
    record = _json_object(
        _field("timeUnixNano", time),
        _field("observedTimeUnixNano", _quoted(F.col("received_at_unix_nano"))),
        _field("severityNumber", F.col("severity_number").cast("string")),
        _field("severityText", _quoted(kind)),
        _field("body", body),
        _field("attributes", attribute_list(*(reversed(attributes) if reverse_attributes else attributes))),
        _field("traceId", _quoted(F.coalesce("trace_id", F.lit("")))),
        _field("spanId", _quoted(F.coalesce("span_id", F.lit("")))),
        _field("eventName", _quoted(F.col("event_name"))),
        _field("flags", (event % 2).cast("string")),
    )
    name = F.when(F.col("service_name") != "unknown_service", string_attribute("service.name", F.col("service_name")))
    element = _text(
        '{"resource":', _json_object(_field("attributes", attribute_list(name, int_attribute("host.slot", user % 3)))),
        ',"schemaUrl":', _quoted(F.col("resource_schema_url")),
        ',"scopeLogs":[{"scope":{"name":"shop","version":', _quoted(F.col("scope_version")),
        '},"logRecords":[', record, "]}]}",
    )
    return _requests(
        source.select(
            "event_id", F.col("received_at_unix_nano").alias("received"), F.lit(0).alias("part"), element.alias("text")
        ),
        "resourceLogs",
    )


@prepared
def span_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span as a request of its own; some carry an event with a credential."""
    event = _text(
        '[{"name":"packed","timeUnixNano":', _quoted(F.col("end_time_unix_nano")),
        ',"attributes":', attribute_list(string_attribute("session_token", F.col("span_id"))), "}]",
    )
    span = _json_object(
        _field("traceId", _quoted(F.col("trace_id"))),
        _field("spanId", _quoted(F.upper("span_id"))),
        _field("parentSpanId", _quoted(F.coalesce("parent_span_id", F.lit("")))),
        _field("name", _quoted(F.col("name"))),
        _field("kind", F.col("kind").cast("string")),
        _field("startTimeUnixNano", _quoted(F.col("start_time_unix_nano"))),
        _field("endTimeUnixNano", F.col("end_time_unix_nano").cast("string")),
        _field("attributes", F.col("attributes")),
        _field("events", F.when(F.col("kind") == 1, event)),
        _field("status", _json_object(
            _field("code", F.col("status_code").cast("string")), _field("message", _quoted(F.col("status_message"))),
        )),
    )
    value = _text(
        '{"resourceSpans":[{"resource":', _json_object(_field("attributes", F.col("resource_attributes"))),
        ',"scopeSpans":[{"scope":{"name":"shipping","version":"2.0"},"spans":[', span, "]}]}]}",
    )
    return spans(spark, sf_dir).select(
        F.lpad(F.col("id").cast("string"), 20, "0").alias("request_key"), "received_at_unix_nano", value.alias("value")
    )


@prepared
def metric_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric points as OTLP-JSON requests with all five types."""
    kind = F.col("metric_type")
    number, histogram = kind.isin("gauge", "sum"), kind.isin("histogram", "exponential_histogram")
    number_text = F.when(
        F.col("number_kind") == "int", _field("asInt", _quoted(F.col("number_int")))
    ).when(F.col("number_kind") == "double", _field("asDouble", F.col("number_double").cast("string")))
    point = _json_object(
        _field("attributes", F.col("attributes")),
        _field("startTimeUnixNano", _quoted(F.col("start_time_unix_nano"))),
        _field("timeUnixNano", _quoted(F.col("time_unix_nano"))),
        _field("flags", F.col("flags").cast("string")),
        F.when(kind != "summary", _field("exemplars", F.col("exemplars"))),
        F.when(number, number_text),
        F.when(~number, _field("count", _quoted(F.col("aggregate_count")))),
        F.when(~number, _field("sum", F.col("aggregate_sum").cast("string"))),
        F.when(histogram, _field("min", F.col("aggregate_min").cast("string"))),
        F.when(histogram, _field("max", F.col("aggregate_max").cast("string"))),
        F.when(kind == "histogram", _field("bucketCounts", F.col("bucket_counts"))),
        F.when(kind == "histogram", _field("explicitBounds", F.col("explicit_bounds"))),
        F.when(kind == "exponential_histogram", _field("scale", F.col("scale").cast("string"))),
        F.when(kind == "exponential_histogram", _field("zeroCount", _quoted(F.col("zero_count")))),
        F.when(kind == "summary", _field("quantileValues", F.col("quantile_values"))),
    )
    code = F.when(F.col("temporality") == "delta", "1").when(F.col("temporality") == "cumulative", "2").otherwise("0")
    data = _json_object(
        _text('"dataPoints":[', point, "]"),
        F.when(~kind.isin("gauge", "summary"), _field("aggregationTemporality", code)),
        F.when(kind == "sum", _field("isMonotonic", F.when(F.col("monotonic") == 1, "true").otherwise("false"))),
    )
    field = F.when(kind == "exponential_histogram", "exponentialHistogram").otherwise(kind)
    element = _text(
        '{"resource":', _json_object(_field("attributes", F.col("resource_attributes"))),
        ',"schemaUrl":', _quoted(F.col("resource_schema_url")),
        ',"scopeMetrics":[{"scope":{"name":"shop","version":', _quoted(F.col("scope_version")),
        '},"metrics":[{"name":', _quoted(F.col("metric_name")), ',"unit":', _quoted(F.col("unit")),
        ',"description":', _quoted(F.col("description")), ',"', field, '":', data, "}]}]}",
    )
    copies = F.lit(100_000_000_000)
    return _requests(
        metric_points(spark, sf_dir).select(
            (F.col("id") % copies).alias("event_id"),
            F.col("received_at_unix_nano").alias("received"),
            F.call_function("div", F.col("id"), copies).alias("part"),
            element.alias("text"),
        ),
        "resourceMetrics",
    )


@prepared
def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the lifetime counters of many processes, one per event."""
    event, user = F.col("event_id"), F.col("user_id")
    since = F.call_function("div", F.col("ns") % TEN_DAYS, F.lit(SECOND))
    return events(spark, sf_dir).select(
        _text("process-", (user % 20).cast("string")).alias("process"),
        F.col("ns").alias("time_unix_nano"),
        event.alias("id"),
        since.alias("committed_logs"),
        F.call_function("div", since, F.lit(60)).alias("committed_spans"),
        F.call_function("div", since, F.lit(3600)).alias("committed_metric_points"),
        F.call_function("div", since, F.lit(86400)).alias("deleted_logs"),
        F.lit(0).cast("bigint").alias("deleted_spans"),
        F.lit(0).cast("bigint").alias("deleted_metric_points"),
        F.call_function("div", since, F.lit(40000)).alias("rejected"),
        (event % 97 != 0).alias("store_ready"),
        F.when(event % 97 == 0, "disk full").otherwise("").alias("last_error"),
        (event % 89 != 0).alias("pipeline_ready"),
    )


def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute keys in many spellings, harmless and sensitive."""
    prefixes = ["", "http.request.header.", "db/", "app:", "X-", "my_", " "]
    names = [
        "Authorization", "set-cookie", "input_tokens", "api_key", "clientSecret", "PASSWORD", "tokens",
        "access-token", "secret", "cookie", "csrf_token.value", "proxy-authorization", "idToken", "session.token",
    ]
    pick = lambda values, index: F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
    event = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id",
        F.concat(
            pick(prefixes, event % len(prefixes)),
            pick(names, F.call_function("div", event, F.lit(len(prefixes))) % len(names)),
        ).alias("key"),
    )
