"""Registered queries: each maps (spark, folder of tables) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import attributes
from tracewell.functions.times import parse_timestamp, rfc3339_nano
from tracewell.model import LOGS, METRICS, SPAN_KINDS, SPAN_STATUSES, SPANS
from tracewell.operators import dedup, ingest, retention, status
from tracewell.plans import page, present, views
from tracewell.plans.filters import Filters
from tracewell.session import configure, shuffles_dropped, work_folder
from tracewell.sources.files import matching
from tracewell.sources.otlp import stream_requests
from tracewell.sources.store import JSON_EACH_FUNCTION, Store
from tracewell.streaming.ingest import deduplicate, ingest_stream
from tracewell.streaming.rate import latest, streaming_rate
from workload import derived

Query = Callable[[SparkSession, str], DataFrame]

EVERYTHING = "1970-01-01T00:00:00Z"
TEN_DAYS = {"since": "2024-01-10T00:00:00Z", "until": "2024-01-20T00:00:00Z", "time_basis": "event"}
TRACE = f"{26:032x}"

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register ``function`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    _REGISTRY[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _all(**changes) -> Filters:
    return Filters(**{"since": EVERYTHING, **changes})


@query
def metric_rate(spark, sf_dir):
    return views.rates(derived.metric_points(spark, sf_dir))


@query
def metric_rate_named(spark, sf_dir):
    filters = Filters(name="shop.click", temporality="delta", **TEN_DAYS)
    return views.metric_rate(derived.metric_points(spark, sf_dir), filters)


@query
def rate_reason_counts(spark, sf_dir):
    rated = views.rates(derived.metric_points(spark, sf_dir), ordered=False)
    return rated.groupBy("rate_reason").agg(
        F.count(F.lit(1)).alias("points"), F.count("gap_seconds").alias("gaps")
    )


@query
def metric_points(spark, sf_dir):
    return views.metric_points(derived.metric_points(spark, sf_dir), _all())


@query
def metric_points_filtered(spark, sf_dir):
    filters = _all(
        resource=["host.slot=1"], attribute=["event.type=click"], metric_type="sum",
        temporality="delta", scope="shop", scope_version="1.0",
    )
    return views.metric_points(derived.metric_points(spark, sf_dir), filters)


@query
def metric_list(spark, sf_dir):
    return views.metric_list(derived.metric_points(spark, sf_dir), _all())


@query
def metric_series(spark, sf_dir):
    return views.metric_series(derived.metric_points(spark, sf_dir), _all())


def _services(spark, sf_dir, filters: Filters) -> DataFrame:
    return views.services(
        derived.logs(spark, sf_dir), derived.spans(spark, sf_dir), derived.metric_points(spark, sf_dir), filters
    )


@query
def services(spark, sf_dir):
    return _services(spark, sf_dir, _all())


@query
def services_event_time(spark, sf_dir):
    return _services(spark, sf_dir, Filters(**TEN_DAYS))


@query
def services_scoped(spark, sf_dir):
    return _services(spark, sf_dir, _all(scope_version="1.1", resource=["host.slot=2"]))


@query
def logs_view(spark, sf_dir):
    return views.logs(derived.logs(spark, sf_dir), _all())


@query
def logs_min_level(spark, sf_dir):
    return views.logs(derived.logs(spark, sf_dir), _all(level="warn"))


@query
def logs_attr_int(spark, sf_dir):
    return views.logs(derived.logs(spark, sf_dir), _all(attribute=["k=7"]))


@query
def logs_attr_string(spark, sf_dir):
    return views.logs(derived.logs(spark, sf_dir), _all(attribute=["event.type=signup"]))


@query
def logs_attr_type_differs(spark, sf_dir):
    return views.logs(derived.logs(spark, sf_dir), _all(attribute=['k="7"']))


@query
def logs_correlated(spark, sf_dir):
    return views.logs(derived.logs(spark, sf_dir), _all(trace_id=TRACE, service="svc-1"))


@query
def spans_view(spark, sf_dir):
    return views.spans(derived.spans(spark, sf_dir), _all())


@query
def spans_filtered(spark, sf_dir):
    filters = _all(kind="server", status="error", min_duration="24h")
    return views.spans(derived.spans(spark, sf_dir), filters)


@query
def spans_attr_bool(spark, sf_dir):
    filters = _all(attribute=["line.open=true", "quantity=17"], name="ship part 3")
    return views.spans(derived.spans(spark, sf_dir), filters)


@query
def trace_timeline(spark, sf_dir):
    timeline = views.traces(derived.logs(spark, sf_dir), derived.spans(spark, sf_dir))
    return timeline.orderBy("trace_id", "time", "kind", "id")


@query
def trace_single(spark, sf_dir):
    return views.trace(derived.logs(spark, sf_dir), derived.spans(spark, sf_dir), TRACE)


@query
def exemplar_traces(spark, sf_dir):
    return views.exemplar_traces(
        derived.metric_points(spark, sf_dir), derived.logs(spark, sf_dir), derived.spans(spark, sf_dir)
    )


# --- Ingest ---------------------------------------------------------------------------


def _ingested(requests: DataFrame, signal: str) -> DataFrame:
    return ingest.records(ingest.build_requests(requests, signal), signal).drop("request_key", "position")


@query
def otlp_logs_ingest(spark, sf_dir):
    return _ingested(derived.log_requests(spark, sf_dir), LOGS)


@query
def otlp_logs_rejected(spark, sf_dir):
    return ingest.rejected(ingest.build_requests(derived.log_requests(spark, sf_dir), LOGS))


@query
def otlp_traces_ingest(spark, sf_dir):
    return _ingested(derived.span_requests(spark, sf_dir), SPANS).drop("payload_json", "payload_bytes", "fingerprint")


@query
def otlp_metrics_ingest(spark, sf_dir):
    rows = _ingested(derived.metric_requests(spark, sf_dir), METRICS)
    return rows.drop("payload_json", "payload_bytes", "fingerprint")


@query
def canonical_order(spark, sf_dir):
    """The order of attributes does not change the identity of a record."""
    both = derived.log_requests(spark, sf_dir).unionByName(derived.log_requests(spark, sf_dir, True))
    return (
        _ingested(both, LOGS)
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("payload_json").alias("payloads"))
    )


@query
def sensitive_keys(spark, sf_dir):
    return derived.attribute_keys(spark, sf_dir).select(
        "event_id", "key", attributes.is_sensitive(F.col("key")).alias("sensitive")
    )


@query
def resource_ids(spark, sf_dir):
    points = derived.metric_points(spark, sf_dir)
    resources = points.select("resource_attributes", "resource_schema_url").distinct()
    identifier = attributes.resource_id(F.col("resource_attributes"), F.col("resource_schema_url"))
    return resources.withColumn("resource_id", identifier)


# --- Deduplication and conflicts ------------------------------------------------------


def _fingerprinted_logs(spark, sf_dir) -> DataFrame:
    identity = F.concat_ws("|", "service_name", "body_json", "severity_text")
    return derived.logs(spark, sf_dir).withColumn("fingerprint", F.sha2(identity, 256))


@query
def log_dedup(spark, sf_dir):
    rows = _fingerprinted_logs(spark, sf_dir).select(
        "fingerprint", "id", "received_at_unix_nano", "service_name", "body_json"
    )
    return dedup.first_copies(rows, ["fingerprint"], ["received_at_unix_nano", "id"])


@query
def logs_unseen(spark, sf_dir):
    """Logs of the later part of the month whose content was not stored before."""
    rows = _fingerprinted_logs(spark, sf_dir).select("fingerprint", "id", "received_at_unix_nano")
    border = parse_timestamp("2024-01-10T00:00:00Z")
    stored = rows.where(F.col("received_at_unix_nano") < border)
    batch = rows.where(F.col("received_at_unix_nano") >= border)
    return dedup.unseen(batch, stored, ["fingerprint"], batch.count())


@query
def points_unseen(spark, sf_dir):
    """Metric points of the later part of the month whose content was not stored before."""
    content = F.concat_ws("|", "metric_name", "service_name", "attributes", F.col("number_int").cast("string"))
    rows = derived.metric_points(spark, sf_dir).withColumn("fingerprint", F.sha2(content, 256))
    border = parse_timestamp("2024-01-10T00:00:00Z")
    stored = rows.where(F.col("received_at_unix_nano") < border)
    batch = rows.where(F.col("received_at_unix_nano") >= border)
    first = dedup.first_copies(batch.select("fingerprint", "id", "received_at_unix_nano"), ["fingerprint"], ["received_at_unix_nano", "id"])
    return dedup.unseen(first, stored, ["fingerprint"], batch.count())


@query
def span_conflicts(spark, sf_dir):
    return dedup.conflicting_identities(derived.spans(spark, sf_dir))


def _decided_spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(new spans, refused requests) where the spans of one service are stored already.

    All spans arrive, the stored ones again; a request holds the spans of one trace and service that were received together.
    """
    key = F.concat_ws("|", F.lpad(F.col("received_at_unix_nano").cast("string"), 20, "0"), "trace_id", "service_name")
    rows = derived.spans(spark, sf_dir).select(
        "received_at_unix_nano", "trace_id", "span_id", "fingerprint", "id", "name", "service_name"
    )
    # As in ingest, the batch is written once and all steps read the written columns; the request follows from them.
    folder = work_folder(spark, "span-batch")
    rows.write.parquet(folder, compression="zstd")
    rows = spark.read.schema(rows.schema).parquet(folder)
    rows = rows.select(key.alias("request_key"), F.array("id").alias("position"), *rows.columns)
    earlier = rows.where("service_name = 'svc-0'").select("trace_id", "span_id", "fingerprint", "received_at_unix_nano", "id")
    stored = dedup.first_copies(earlier, dedup.SPAN_IDENTITY, ["received_at_unix_nano", "id"])
    return dedup.accepted_spans(rows, stored, rows.count())


@query
def span_accepted(spark, sf_dir):
    return _decided_spans(spark, sf_dir)[0].drop("position", "service_name")


@query
def span_requests_refused(spark, sf_dir):
    return _decided_spans(spark, sf_dir)[1]


@query
def attribute_counts(spark, sf_dir):
    """Attributes of spans by key and type, counted by ad-hoc SQL."""
    spark.sql(JSON_EACH_FUNCTION)
    derived.spans(spark, sf_dir).createOrReplaceTempView(SPANS)
    text = """
      SELECT get_json_object(a.value, '$.key') AS key, v.key AS type, count(*) AS spans, count(DISTINCT v.value) AS values
      FROM otel_spans s, LATERAL json_each(s.attributes) AS a, LATERAL json_each(get_json_object(a.value, '$.value')) AS v
      GROUP BY 1, 2"""
    return page.sql(spark, text)


# --- Retention and status -------------------------------------------------------------


def _sized_tables(spark, sf_dir) -> dict[str, DataFrame]:
    size = F.octet_length("attributes") + F.octet_length("resource_attributes")
    return {
        LOGS: derived.logs(spark, sf_dir).withColumn("payload_bytes", size.cast("bigint")),
        SPANS: derived.spans(spark, sf_dir).withColumn("payload_bytes", size.cast("bigint")),
        METRICS: derived.metric_points(spark, sf_dir).withColumn("payload_bytes", size.cast("bigint")),
    }


def _stored(spark, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What retention reads of the tables, as stored tables, which is what a store has."""
    folder = work_folder(spark, "retention-tables")
    for name, table in tables.items():
        table.select("received_at_unix_nano", "id", "payload_bytes").write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


def _kept(tables: dict[str, DataFrame], mark: retention.Mark) -> DataFrame:
    return retention.keys({name: retention.kept(table, name, mark) for name, table in tables.items()})


@query
def retention_age(spark, sf_dir):
    now = parse_timestamp("2024-01-20T00:00:00Z")
    return _kept(_sized_tables(spark, sf_dir), retention.age_mark(now, hours=240))


@query
def retention_size(spark, sf_dir):
    tables = _stored(spark, _sized_tables(spark, sf_dir))
    keys = retention.keys(tables)
    half = keys.agg(F.sum("bytes")).first()[0] // 2
    return _kept(tables, retention.size_mark(keys, half, batch=1))


@query
def retention_size_batched(spark, sf_dir):
    tables = _stored(spark, _sized_tables(spark, sf_dir))
    keys = retention.keys(tables)
    tenth = keys.agg(F.sum("bytes")).first()[0] // 10
    return _kept(tables, retention.size_mark(keys, tenth))


@query
def store_status(spark, sf_dir):
    return retention.keys(_sized_tables(spark, sf_dir)).groupBy("signal").agg(
        F.count(F.lit(1)).alias("stored"),
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.min("received"), F.lit(0)).alias("oldest_received_at"),
    )


@query
def counter_deltas(spark, sf_dir):
    compared = status.snapshots_with_previous(derived.status_history(spark, sf_dir))
    current, before = F.col("committed_logs"), F.col("previous_committed_logs")
    return compared.select(
        "process", "id", status.counter_delta(before, current).alias("logs_written"),
        (F.col("previous_time_unix_nano").isNotNull() & status.changed()).alias("changed"),
    )


@query
def activity(spark, sf_dir):
    return status.activity(derived.status_history(spark, sf_dir))


@query
def activity_heartbeats(spark, sf_dir):
    """Reports of changes and, where nothing changes, one a minute."""
    return status.activity(derived.status_history(spark, sf_dir), heartbeat_seconds=status.HEARTBEAT_SECONDS)


# --- Presentation, paging and ad-hoc SQL ----------------------------------------------


@query
def rfc3339_nanos(spark, sf_dir):
    rows = derived.logs(spark, sf_dir)
    return rows.select(
        "id",
        rfc3339_nano(F.col("time_unix_nano")).alias("time"),
        rfc3339_nano(F.col("received_at_unix_nano") + F.col("id") % 1000).alias("received_at"),
    )


@query
def log_summary(spark, sf_dir):
    rows = derived.logs(spark, sf_dir)
    summary = present.summary(views.logs(rows, _all(), ordered=False), "logs")
    return summary.groupBy(*summary.columns).agg(F.count(F.lit(1)).alias("n"))


@query
def span_labels(spark, sf_dir):
    rows = derived.spans(spark, sf_dir)
    return rows.groupBy(
        present.label(F.col("kind"), SPAN_KINDS).alias("kind"),
        present.label(F.col("status_code"), SPAN_STATUSES).alias("status"),
    ).agg(F.count(F.lit(1)).alias("spans"), F.count(views.duration_ms()).alias("timed"))


@query
def attribute_texts(spark, sf_dir):
    rows = derived.spans(spark, sf_dir)
    return rows.select("id", present.attribute_text(F.col("attributes")).alias("attributes"))


@query
def document_cells(spark, sf_dir):
    texts = derived.table(spark, sf_dir, "documents")
    cell = present.safe_cell(F.col("text"))
    return texts.select("doc_id", cell.alias("cell"), present.shortened(cell).alias("short"))


@query
def logs_page(spark, sf_dir):
    view = views.logs(derived.logs(spark, sf_dir), _all(level="warn"))
    return page.window(view, page.Options(limit=100, offset=50)).select("id", "received_at", "service_name")


@query
def logs_nonempty_fields(spark, sf_dir):
    fields = page.drop_empty(views.logs(derived.logs(spark, sf_dir), _all(), ordered=False))
    return fields.select(F.explode(F.map_keys("fields")).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def adhoc_sql(spark, sf_dir):
    derived.logs(spark, sf_dir).createOrReplaceTempView(LOGS)
    derived.spans(spark, sf_dir).createOrReplaceTempView(SPANS)
    text = """
      WITH errors AS (SELECT trace_id, count(*) AS errors FROM otel_logs
                      WHERE severity_number >= :level AND trace_id IS NOT NULL GROUP BY trace_id)
      SELECT s.trace_id, e.errors, count(DISTINCT s.service_name) AS services,
             max(s.end_time_unix_nano) AS last_end
      FROM otel_spans s JOIN errors e ON s.trace_id = e.trace_id
      WHERE s.attributes LIKE '%"line.open"%' GROUP BY s.trace_id, e.errors"""
    return page.sql(spark, text, {"level": 17})


# --- Streaming ------------------------------------------------------------------------


def _written_stream(spark, frame: DataFrame, files: int, order: str, folder: str) -> DataFrame:
    frame.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(folder)
    stored = spark.read.parquet(folder)
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", max(files // 2, 1)).parquet(folder)


def _run(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all its input and read back what it wrote."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    started = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_dedup(spark, sf_dir):
    folder = work_folder(spark, "stream-dedup")
    rows = _fingerprinted_logs(spark, sf_dir).select("fingerprint", "id", "received_at_unix_nano")
    stream = _written_stream(spark, rows, 4, "received_at_unix_nano", f"{folder}/in")
    copies = deduplicate(stream, LOGS, retention_hours=24 * 60)
    return _run(copies, folder).select("fingerprint")


_CLOSING = "closing marker"


POINTS_PER_FILE = 250_000


def _rated_stream(spark, points: DataFrame, arrival, folder: str, **periods) -> DataFrame:
    """Points written in order of arrival, quarter after quarter, and rated as a stream of two quarters a batch."""
    points.withColumn("_arrival", arrival).write.parquet(f"{folder}/points")
    points = spark.read.parquet(f"{folder}/points")
    cuts = points.approxQuantile("_arrival", [0.25, 0.5, 0.75], 0.01)
    files = points.count() // (4 * POINTS_PER_FILE) + 1
    arrival = F.col("_arrival")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = points if low is None else points.where(arrival >= F.lit(low))
        part = part if high is None else part.where(arrival < F.lit(high))
        part.drop("_arrival").repartition(files).write.mode("append").parquet(f"{folder}/in")
    # A point of no series of ours, later than all others by more than the delay, lets the watermark pass the last of them.
    points = points.drop("_arrival")
    closing = points.orderBy(F.desc("time_unix_nano")).limit(1)
    closing = closing.withColumn("time_unix_nano", F.col("time_unix_nano") + 2 * 3600 * 10**9)
    closing = closing.withColumn("metric_name", F.lit(_CLOSING)).select(points.columns)
    closing.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2 * files).parquet(f"{folder}/in")
    return _run(streaming_rate(stream, "1 hour", **periods), folder).where(F.col("metric_name") != _CLOSING)


@query
def stream_rate(spark, sf_dir):
    points = derived.metric_points(spark, sf_dir)
    rated = _rated_stream(spark, points, F.col("time_unix_nano"), work_folder(spark, "stream-rate"))
    return rated.select("id", "value", "delta_value", "rate_per_second", "rate_reason", "gap_seconds")


@query
def stream_rate_corrected(spark, sf_dir):
    """Points arrive up to six hours late, in any order; the newest revisions equal the rates of the full history."""
    points = derived.metric_points(spark, sf_dir)
    late = F.pmod(F.xxhash64("id"), F.lit(6 * 3600)) * 10**9
    arrival = F.col("time_unix_nano") + late
    rated = _rated_stream(spark, points, arrival, work_folder(spark, "stream-corrected"), correction="12 hours", idle="90 days")
    return latest(rated).select("id", "value", "delta_value", "rate_per_second", "rate_reason", "gap_seconds")


REQUESTS_PER_FILE = 5_000
REQUESTS_PER_TASK = 250
MICRO_BATCHES = 8


@query
def stream_ingest(spark, sf_dir):
    """Requests arrive twice, in several micro-batches; the store holds each record once."""
    folder = work_folder(spark, "stream-ingest")
    arrived = {"maxRecordsPerFile": REQUESTS_PER_FILE, "compression": "gzip"}
    with shuffles_dropped(spark):
        derived.log_requests(spark, sf_dir).select("value").write.options(**arrived).text(f"{folder}/in")
        requests = spark.read.text(f"{folder}/in")
        tasks = 2 * requests.count() // MICRO_BATCHES // REQUESTS_PER_TASK
        requests.write.mode("append").options(**arrived).text(f"{folder}/in")
    # A micro-batch is a share of the input, and so is the disk that it needs for itself.
    files = -(-len(matching(spark, f"{folder}/in/part-*")) // MICRO_BATCHES)
    store = Store.create(spark, f"{folder}/store")
    received = F.lit(parse_timestamp("2024-02-01T00:00:00Z"))
    arriving = stream_requests(spark, f"{folder}/in", received, max_files_per_trigger=files)
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    ingest_stream(arriving, store, LOGS, f"{folder}/checkpoint", "logs", available_now=True, tasks=tasks).awaitTermination()
    return views.logs(store.refresh().table(LOGS), _all()).drop("id")
