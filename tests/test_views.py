import io

import pytest

from tracewell.model import LOG_SCHEMA, LOGS, METRIC_SCHEMA, SPAN_SCHEMA
from tracewell.operators import status
from tracewell.plans import catalog, page, present, views
from tracewell.plans.filters import Filters, window

NOW = 1_700_000_000 * 10**9


@pytest.mark.parametrize("payload", [False, True])
def test_catalog_equals_views(spark, payload):
    logs, spans, points = (spark.createDataFrame([], s) for s in (LOG_SCHEMA, SPAN_SCHEMA, METRIC_SCHEMA))
    made = {
        "logs": views.logs(logs, Filters(), payload),
        "spans": views.spans(spans, Filters(), payload),
        "trace": views.trace(logs, spans, "1" * 32, payload),
        "services": views.services(logs, spans, points, Filters()),
        "metrics points": views.metric_points(points, Filters(), payload),
        "metrics rate": views.rates(points, payload, hot_parts=0),
    }
    if not payload:
        made["metrics list"] = views.metric_list(points, Filters())
        made["metrics series"] = views.metric_series(points, Filters())
    for name, view in made.items():
        assert view.columns == catalog.output_columns(name, payload), name
        if name in catalog.SUMMARY_COLUMNS:
            assert set(catalog.SUMMARY_COLUMNS[name]) <= set(view.columns)
            assert present.summary(view, name).columns == catalog.SUMMARY_COLUMNS[name]
    if payload:
        for name in catalog.DISCOVERY:
            with pytest.raises(ValueError):
                catalog.output_columns(name, True)


def test_windows():
    assert window(Filters(since="15m", now_nanos=NOW)) == (NOW - 900 * 10**9, None)
    assert window(Filters(since="2023-01-01T00:00:00Z", until="2023-01-02T00:00:00Z"))[1] == 1672617600 * 10**9
    for bad in [
        {"since": "-5m"}, {"since": "0s"}, {"since": "yesterday"}, {"since": "1969-01-01T00:00:00Z"}, {"since": "2300-01-01T00:00:00Z"},
        {"since": "2023-01-02T00:00:00Z", "until": "2023-01-02T00:00:00Z"}, {"until": "soon"},
    ]:
        with pytest.raises(ValueError):
            window(Filters(**bad))


def test_bad_filters(spark):
    logs, spans, points = (spark.createDataFrame([], s) for s in (LOG_SCHEMA, SPAN_SCHEMA, METRIC_SCHEMA))
    for view, table, bad in [
        (views.logs, logs, {"level": "loud"}), (views.logs, logs, {"trace_id": "0" * 32}), (views.logs, logs, {"span_id": "zz"}),
        (views.logs, logs, {"time_basis": "other"}), (views.logs, logs, {"attribute": ["a=1"] * 33}),
        (views.spans, spans, {"kind": "x"}), (views.spans, spans, {"status": "x"}), (views.spans, spans, {"min_duration": "-1s"}),
        (views.metric_points, points, {"metric_type": "x"}), (views.metric_points, points, {"temporality": "x"}),
        (views.metric_points, points, {"resource_id": "x"}), (views.metric_rate, points, {"name": " "}),
    ]:
        with pytest.raises(ValueError):
            view(table, Filters(**bad))
    with pytest.raises(ValueError):
        views.trace(logs, spans, "12")


def numbers(spark, count):
    return spark.range(count).selectExpr("id", "concat('row ', id) AS text", "'' AS none", "id % 2 = 0 AS even").orderBy("id")


def test_row_limit(spark):
    got = page.read(numbers(spark, 5), page.Options(limit=2, offset=1, timeout_seconds=30))
    assert (got.count, got.truncated, got.truncation_reason, got.next_offset) == (2, True, "row_limit", 3)
    assert got.columns == ["id", "text", "even"] and got.rows[0] == {"id": 1, "text": "row 1", "even": False}
    last = page.read(numbers(spark, 5), page.Options(limit=2, offset=3, timeout_seconds=30))
    assert not last.truncated and "next_offset" not in last.to_json()


def test_columns_and_bytes(spark):
    view = numbers(spark, 100)
    got = page.read(view, page.Options(columns=["text", "id"], include_empty=True, timeout_seconds=30))
    assert got.columns == ["text", "id"] and got.count == 100
    small = page.read(view, page.Options(max_bytes=1024, timeout_seconds=30))
    assert small.truncation_reason == "byte_limit" and 0 < small.count < 100 and len(small.to_json()) <= 1024
    for bad in (["id", "id"], ["nope"]):
        with pytest.raises(ValueError):
            page.read(view, page.Options(columns=bad))
    with pytest.raises(ValueError, match="first row"):
        page.read(spark.sql("SELECT repeat('x', 5000) AS a"), page.Options(max_bytes=1024, timeout_seconds=30))
    assert page.read(view, page.Options(columns_only=True)).columns == ["id", "text", "none", "even"]
    for bad in ({"limit": 0}, {"limit": 10_001}, {"offset": -1}, {"max_bytes": 10}, {"timeout_seconds": 31}):
        with pytest.raises(ValueError):
            page.Options(**bad).check()


def test_telemetry_values(spark):
    view = spark.sql("SELECT 0L AS time, 1000000001L AS received_at, '[]' AS events, '{\"a\":[]}' AS body, 1 AS monotonic")
    got = page.read(view, page.Options(timeout_seconds=30))
    assert got.rows == [{"received_at": "1970-01-01T00:00:01.000000001Z", "body": {"a": []}, "monotonic": True}]


def test_deadline(spark):
    slow = spark.range(10**12).selectExpr("sum(hash(id)) AS s")
    with pytest.raises(TimeoutError):
        page.read(slow, page.Options(timeout_seconds=0.5))


def test_sql(spark):
    spark.range(3).createOrReplaceTempView(LOGS)
    assert page.sql(spark, "SELECT id FROM otel_logs WHERE id > :low;", {"low": 0}).count() == 2
    assert page.sql(spark, "WITH a AS (SELECT 1 AS x UNION ALL SELECT 2) SELECT * FROM a -- done").count() == 2
    assert page.sql(spark, "SELECT ';' AS a").first().a == ";"
    for bad in [
        "", "DROP VIEW otel_logs", "SELECT 1; SELECT 2", "INSERT INTO otel_logs VALUES (1)", "SET a=b", "SELECT 1 AS a, 2 AS a",
        "SELECT reflect('java.lang.System', 'nanoTime') AS a", "SELECT * FROM text.`/etc/hostname`", "CREATE TABLE x AS SELECT 1",
        "SELECT '" + "x" * 70_000 + "' AS a",
    ]:
        with pytest.raises(ValueError):
            page.sql(spark, bad)


def test_query_text(tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT 1")
    assert page.query_text(file=str(path)) == page.query_text(query="SELECT 1") == page.query_text(stdin=io.StringIO("SELECT 1"))
    with pytest.raises(ValueError):
        page.query_text()
    with pytest.raises(ValueError):
        page.query_text(query="a", file="b")


def test_activity(spark):
    def snapshot(seconds, logs, rejected=0, ready=True):
        return ("p", seconds * 10**9, seconds, logs, 0, 0, 0, 0, 0, rejected, ready, "", True)

    from tracewell.streaming.activity import SNAPSHOT_SCHEMA

    history = [snapshot(1, 5), snapshot(11, 9), snapshot(12, 10), snapshot(25, 10), snapshot(35, 3), snapshot(45, 3, 1), snapshot(55, 3, 1, False)]
    rows = status.activity(spark.createDataFrame(history, SNAPSHOT_SCHEMA)).orderBy("reported_at").collect()
    assert [(r.reported_at // 10**9, r.logs_written, r.requests_rejected, r.severity) for r in rows] == [
        (20, 5, 0, "info"), (40, 3, 0, "info"), (50, 0, 1, "warn"), (60, 0, 0, "warn"),
    ]


def test_offsets_of_few_traces_shuffle_no_timeline(spark):
    """The beginnings of the traces are written first, so their small size is known and they are broadcast."""
    from tracewell.plans import views
    from workload import derived

    folder = "/root/testdata/sf0.001"
    timeline = views.traces(derived.logs(spark, folder), derived.spans(spark, folder))
    plan = timeline._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "trace_id" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    assert timeline.where("offset_ms < 0 OR offset_ms IS NULL").isEmpty()
