import json
import os

import pytest
from pyspark.sql import functions as F

import otlp
from tracewell.model import LOGS, METRICS, SPANS
from tracewell.operators import ingest
from tracewell.sources.otlp import read_requests, stream_requests
from tracewell.sources.store import Store


def rows(requests, signal, texts):
    built = ingest.build_requests(requests(texts), signal)
    return [r.asDict() for r in ingest.records(built, signal).orderBy("request_key", "position").collect()]


def reasons(requests, signal, texts):
    built = ingest.build_requests(requests(texts), signal)
    return {r.request_key: r.reason for r in ingest.rejected(built).collect()}


def test_log_columns_and_redaction(requests):
    text = otlp.log(
        otlp.mapping(message="ready", password="hidden-body", list=otlp.array(otlp.mapping(token="hidden-list"))),
        [("authorization", "hidden-attribute"), ("event.name", "started"), ("request.id", "r1"), ("product.id", "p1"),
         ("app.component", "ui"), ("input_tokens", 12)],
        severityNumber=9, traceId="0" * 32, spanId="00112233AABBCCDD", timeUnixNano="5",
    )
    (row,) = rows(requests, LOGS, [text])
    assert "hidden" not in str(row)
    assert (row["service_name"], row["op"], row["request_id"], row["product_id"], row["component"]) == (
        "shop", "started", "r1", "p1", "ui",
    )
    assert row["trace_id"] is None and row["span_id"] == "00112233aabbccdd" and row["time_unix_nano"] == 5
    body = json.loads(row["body_json"])
    assert [e["key"] for e in body["map"]] == ["message", "password", "list"]
    payload = json.loads(row["payload_json"])["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert [a["key"] for a in payload["attributes"]] == sorted(a["key"] for a in payload["attributes"])
    assert [e["key"] for e in payload["body"]["kvlistValue"]["values"]] == ["list", "message", "password"]


@pytest.mark.parametrize(
    "body,want",
    [
        ("x", {"string": "x"}), ({"boolValue": True}, {"bool": True}), ({"intValue": "9007199254740993"}, {"int": "9007199254740993"}),
        ({"doubleValue": 1.5}, {"double": 1.5}), ({"doubleValue": "NaN"}, {"double": "NaN"}),
        ({"doubleValue": "Infinity"}, {"double": "+Infinity"}), ({"bytesValue": "AQI="}, {"bytes": "AQI="}), ({}, {"empty": True}),
        (otlp.array("a", 1), {"array": [{"string": "a"}, {"int": "1"}]}),
    ],
)
def test_tagged_bodies(requests, body, want):
    (row,) = rows(requests, LOGS, [otlp.log(body)])
    assert json.loads(row["body_json"]) == want


def test_fingerprint_ignores_order_and_secrets_only(requests):
    a, b = ("b", 1), ("a", otlp.mapping(y="1", x="2"))
    texts = [
        otlp.log(attributes=[a, b]),
        otlp.log(attributes=[("a", otlp.mapping(x="2", y="1")), a]),
        otlp.log(attributes=[a, ("a", otlp.mapping(y="1", x="3"))]),
        otlp.log(attributes=[("token", "one")]),
        otlp.log(attributes=[("token", "two")]),
        otlp.log(attributes=[("l", otlp.array(1, 2))]),
        otlp.log(attributes=[("l", otlp.array(2, 1))]),
        otlp.log(attributes=[("d", {"doubleValue": 1})]),
        otlp.log(attributes=[("d", {"doubleValue": 1.0})]),
        otlp.log(attributes=[("i", {"intValue": 1})]),
        otlp.log(attributes=[("i", {"intValue": "1"})]),
    ]
    prints = [r["fingerprint"] for r in rows(requests, LOGS, texts)]
    assert prints[0] == prints[1] != prints[2]
    assert prints[3] == prints[4]
    assert prints[5] != prints[6]
    assert prints[7] == prints[8] and prints[9] == prints[10]


def test_rejections(requests):
    deep = {"stringValue": "x"}
    for _ in range(17):
        deep = {"arrayValue": {"values": [deep]}}
    texts = [
        "{",
        otlp.log(timeUnixNano="9223372036854775808"),
        otlp.log(deep),
        otlp.log("x" * (1 << 20) + "y"),
        otlp.log(attributes=[("k", "v" * ((1 << 20) + 1))]),
        otlp.log(attributes=[("k", {"intValue": "x"})]),
        otlp.log(traceId="xyz"),
        json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{}] * 10_001}]}]}),
        otlp.log(),
        "{}",
    ]
    got = reasons(requests, LOGS, texts)
    assert got["r0000"] == "malformed request"
    assert "2^63" in got["r0001"] and "nested" in got["r0002"] and "1 MiB" in got["r0003"] and "1 MiB" in got["r0004"]
    assert got["r0005"] == got["r0006"] == "malformed request"
    assert "10000" in got["r0007"]
    assert set(got) == {f"r{i:04d}" for i in range(8)}


def test_one_bad_record_rejects_the_request(requests):
    text = json.dumps(
        {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": "fine"}}, {"timeUnixNano": "18446744073709551615"}]}]}]}
    )
    assert rows(requests, LOGS, [text]) == [] and len(reasons(requests, LOGS, [text])) == 1


def test_spans(requests):
    good = otlp.spans((1, 1, "a"), (1, 2, "b"))
    missing = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "0" * 32, "spanId": "1" * 16}]}]}]})
    assert [r["name"] for r in rows(requests, SPANS, [good, missing])] == ["a", "b"]
    assert "no trace_id" in reasons(requests, SPANS, [good, missing])["r0001"]
    linked = json.loads(good)
    linked["resourceSpans"][0]["scopeSpans"][0]["spans"][0] |= {
        "links": [{"traceId": "1" * 32, "spanId": "1" * 16, "attributes": [otlp.attribute("cookie", "hidden")]}],
        "status": {"code": 2, "message": "no"}, "kind": 3,
    }
    first = rows(requests, SPANS, [json.dumps(linked)])[0]
    assert "hidden" not in str(first) and first["status_code"] == 2 and first["kind"] == 3


def test_metrics(requests):
    exemplar = {"asDouble": 1.5, "filteredAttributes": [otlp.attribute("token", "hidden")], "traceId": "1" * 32}
    texts = [
        otlp.metric("g", "gauge", {"asInt": "9007199254740993", "timeUnixNano": "7", "exemplars": [exemplar]}),
        otlp.metric("s", "sum", {"asDouble": "NaN"}, aggregationTemporality=1, isMonotonic=True),
        otlp.metric("h", "histogram", {"count": "18446744073709551615", "sum": "Infinity", "min": 1, "max": 3,
                    "bucketCounts": ["1", "2"], "explicitBounds": [1, 2.5]}, aggregationTemporality=2),
        otlp.metric("e", "exponentialHistogram", {"count": "2", "scale": 1, "zeroCount": "1", "zeroThreshold": 0.1,
                    "positive": {"offset": -1, "bucketCounts": ["1"]}}, aggregationTemporality=2),
        otlp.metric("q", "summary", {"count": "2", "quantileValues": [{"quantile": 0.5, "value": 1}]}),
        json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "none"}]}]}]}),
        json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "empty", "gauge": {}}]}]}]}),
        otlp.metric("late", "summary", {"timeUnixNano": "9223372036854775808"}),
    ]
    got = {r["metric_name"]: r for r in rows(requests, METRICS, texts)}
    assert set(got) == {"g", "s", "h", "e", "q"}
    assert got["g"]["number_int"] == 9007199254740993 and got["g"]["number_kind"] == "int"
    assert "hidden" not in str(got["g"])
    assert got["s"]["number_kind"] == "double" and got["s"]["number_double"] is None
    assert (got["s"]["temporality"], got["s"]["monotonic"]) == ("delta", 1)
    assert got["h"]["aggregate_count"] == "18446744073709551615" and got["h"]["aggregate_sum"] is None
    assert (got["h"]["aggregate_min"], got["h"]["bucket_counts"]) == (1.0, '["1","2"]')
    assert json.loads(got["e"]["positive"]) == {"bucketCounts": ["1"], "offset": -1} and got["e"]["scale"] == 1
    assert got["q"]["temporality"] == "unspecified" and got["q"]["aggregate_sum"] == 0.0
    for row in got.values():
        json.loads(row["payload_json"])
    refused = reasons(requests, METRICS, texts)
    assert refused == {"r0005": "a metric has no data", "r0007": "a metric timestamp is not in 0..2^63-1"}


def test_text_source(spark, folder):
    spark.createDataFrame([(otlp.log("a"),), ("",), (otlp.log("b"),)], "value string").write.text(folder)
    read = read_requests(spark, folder)
    assert read.columns == ["request_key", "received_at_unix_nano", "value"]
    assert read.count() == 2 and read.agg(F.min("received_at_unix_nano")).first()[0] > 10**18


@pytest.mark.parametrize(
    "fields",
    [
        {"timeUnixNano": "-5"}, {"severityNumber": "SEVERITY_NUMBER_ERROR"}, {"flags": "abc"}, {"observedTimeUnixNano": "x"},
        {"body": {"arrayValue": {"values": [{"intValue": "99999999999999999999"}]}}},
        {"body": {"arrayValue": {"values": [{"bytesValue": "!!!"}]}}},
    ],
)
def test_malformed_numbers_are_refused(requests, fields):
    assert list(reasons(requests, LOGS, [otlp.log("fine"), otlp.log(**fields)])) == ["r0001"]


def test_plain_values_are_not_walked_beside_nested_ones(monkeypatch):
    """Of a request with one nested body, the scalar attributes pass as they are; the result is the same as before."""
    import json

    from tracewell.functions import anyvalue

    walked = []
    walk = anyvalue._walk
    monkeypatch.setattr(anyvalue, "_walk", lambda waiting: (walked.extend(waiting), walk(waiting)))
    plain = [{"key": "k", "value": {"intValue": "7"}}, {"key": "password", "value": {"stringValue": "p"}}]
    odd = [{"key": "k", "value": {"intValue": "007"}}, {"key": "é", "value": {"stringValue": "s"}}]
    nested = {"kvlistValue": {"values": [{"key": "token", "value": {"stringValue": "t"}}]}}
    records = [{"body": nested, "attributes": plain + odd}, {"body": {"stringValue": "text"}, "attributes": plain}]
    text, error = anyvalue.normalize_request(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": records}]}]}))
    first, second = json.loads(text)["resourceLogs"][0]["scopeLogs"][0]["logRecords"]
    assert error is None and len(walked) == 3
    assert first["attributes"] == plain + [{"key": "k", "value": {"intValue": "7"}}, odd[1]]
    assert json.loads(second["taggedBody"]) == {"string": "text"} and "REDACTED" in first["taggedBody"]
    lone = '{"attributes":[{"key":"a","value":{"stringValue":"\\ud800"}}]}'
    assert anyvalue.normalize_request(lone) == (None, "malformed request")


def test_requests_are_derived_without_a_join(spark, monkeypatch):
    """Requests of logs need their events only, and those of the stream are dealt over files that grow with them."""
    from workload import derived, queries

    folder = "/root/testdata/sf0.001"
    plan = derived.log_requests(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    whole = sorted(map(str, queries.queries()["stream_ingest"](spark, folder).collect()))
    written = []
    monkeypatch.setattr(queries, "REQUESTS_PER_FILE", 1)
    monkeypatch.setattr(queries, "stream_requests", lambda s, path, *a, **o: written.append(path) or stream_requests(s, path, *a, **o))
    assert sorted(map(str, queries.queries()["stream_ingest"](spark, folder).collect())) == whole
    assert len([name for name in os.listdir(written[0]) if name.startswith("part-")]) > 3


def test_stream_ingest_needs_little_disk(spark, monkeypatch):
    """The stream's input lies compressed on disk, a micro-batch is a share of it, and its staged rows and shuffles go with it."""
    from workload import derived, queries

    folder = "/root/testdata/sf0.001"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    local = list(blocks.localDirsString())
    seen, roots, whole = [], [], Store.ingest

    def shuffles():
        return {f"{at}/{name}" for top in local for at, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}

    def watched(store, requests, *options, **named):
        before = shuffles()
        done = whole(store, requests, *options, **named)
        seen.append((done.inserted, shuffles() - before, os.listdir(f"{store.root}/_staging")))
        roots.append(store.root)
        return done

    monkeypatch.setattr(queries, "REQUESTS_PER_FILE", 3)
    monkeypatch.setattr(Store, "ingest", watched)
    rows = queries.queries()["stream_ingest"](spark, folder).count()
    text = derived.log_requests(spark, folder).agg(F.sum(F.octet_length("value"))).first()[0]
    base = os.path.dirname(roots[0])
    landed = sum(os.path.getsize(f"{at}/{name}") for top in os.listdir(base) if top not in ("store", "checkpoint")
                 for at, _, names in os.walk(f"{base}/{top}") for name in names)
    assert landed < text
    assert sum(inserted for inserted, _, _ in seen) == rows
    assert len(seen) > 4 and max(inserted for inserted, _, _ in seen) < rows / 2
    assert not any(left or staged for _, left, staged in seen)
