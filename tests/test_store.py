import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

import otlp
from tracewell.model import LOGS, METRIC_IDENTITY, METRICS, SPANS
from tracewell.operators import dedup, discovery, retention, status
from tracewell.plans import page, views
from tracewell.plans.filters import Filters
from tracewell.sources import files
from tracewell.sources.otlp import stream_requests
from tracewell.sources.store import Store, StoreError, open_store
from tracewell.streaming.activity import StatusHistory, history, observed_counts
from tracewell.streaming.ingest import deduplicate, ingest_stream
from workload import derived

HOUR = 3600 * 10**9


def test_append_replay_conflict_retention_clear(spark, folder, requests):
    store = Store.create(spark, folder)
    texts = [otlp.log("a"), otlp.log("a"), otlp.log("b"), "{bad"]
    result = store.ingest(requests(texts), LOGS)
    assert (result.inserted, result.refused) == (2, 1)
    assert store.ingest(requests(texts[:3], received=10**18 + HOUR), LOGS).inserted == 0
    spans = [otlp.spans((1, 1, "x")), otlp.spans((1, 1, "y"), (1, 2, "q")), otlp.spans((1, 2, "z"), (1, 1, "x"))]
    result = store.ingest(requests(spans, received=10**18 + HOUR), SPANS)
    assert (result.inserted, result.refused) == (2, 1)
    assert sorted(r.name for r in store.table(SPANS).collect()) == ["x", "z"]
    result = store.ingest(requests([otlp.spans((1, 2, "other"), (9, 9, "n"))], prefix="s"), SPANS)
    assert (result.inserted, result.refused) == (0, 1)
    assert store.rejected_requests().count() == 3

    ids = [r.id for r in store.table(LOGS).orderBy("received_at_unix_nano").collect()]
    assert ids == sorted(ids) and len(set(ids)) == 2

    reader = open_store(spark, folder)
    status = {r.signal: r for r in reader.status().collect()}
    assert status[LOGS].stored == 2 and status[LOGS].oldest_received_at == 10**18
    assert status[METRICS].oldest_received_at == 0

    # The receipt time decides, and an expired record may come again.
    gone = store.expire_by_age(now_nanos=10**18 + 48 * HOUR + 1)
    assert gone == {LOGS: 1, SPANS: 0, METRICS: 0}
    assert store.ingest(requests([otlp.log("a")], received=10**18 + 2 * HOUR), LOGS).inserted == 1

    with pytest.raises(ValueError):
        store.clear(False, folder)
    with pytest.raises(ValueError):
        store.clear(True, folder + "x")
    cleared = store.clear(True, folder)
    assert (cleared["logs"], cleared["spans"], cleared["metric_points"]) == (2, 2, 0)
    assert store.clear(True, folder)["logs"] == 0
    assert store.ingest(requests(texts[:1]), LOGS).inserted == 1


def test_open_refuses(spark, folder):
    with pytest.raises(StoreError):
        open_store(spark, folder)
    assert not files.exists(spark, folder)
    files.create_text(spark, f"{folder}/_state/000000000001.json", '{"other": 1}')
    with pytest.raises(StoreError):
        open_store(spark, folder)


def test_second_writer_fails(spark, folder, requests):
    one = Store.create(spark, folder)
    two = Store.create(spark, folder)
    one.ingest(requests([otlp.log("a")]), LOGS)
    with pytest.raises(Exception):
        two.ingest(requests([otlp.log("b")]), LOGS)
    assert open_store(spark, folder).table(LOGS).count() == 1


def test_old_dates_are_dropped(spark, folder, requests):
    store = Store.create(spark, folder)
    store.ingest(requests([otlp.log("old")]), LOGS)
    store.ingest(requests([otlp.log("new")], received=10**18 + 100 * HOUR), LOGS)
    store.expire_by_age(now_nanos=10**18 + 101 * HOUR)
    assert store.table(LOGS).count() == 1
    assert len(files.matching(spark, f"{folder}/g1/otel_logs/batch=*/received_date=*")) == 1


def test_stream_replay(spark, folder):
    requests = spark.createDataFrame([(otlp.log(str(i)),) for i in range(20)], "value string")
    requests.repartition(3).write.text(f"{folder}/in")
    store = Store.create(spark, f"{folder}/store")

    def run(checkpoint):
        arriving = stream_requests(spark, f"{folder}/in", F.lit(10**18), max_files_per_trigger=1)
        ingest_stream(arriving, store, LOGS, f"{folder}/{checkpoint}", checkpoint, available_now=True).awaitTermination()
        return store.refresh().table(LOGS).count()

    assert run("first") == 20
    requests.limit(5).write.mode("append").text(f"{folder}/in")
    assert run("first") == 20
    assert run("second") == 20  # a query without the checkpoint reads everything again
    # A micro-batch that was committed before is skipped as a whole.
    assert store.ingest(requests.limit(0), LOGS, stream=("second", 0)).inserted == 0


def _sequential(requests, stored):
    held, refused = dict(stored), set()
    for key, spans in requests:
        new = {}
        for identity, content in spans:
            if new.get(identity, held.get(identity, content)) != content:
                refused.add(key)
                break
            new[identity] = content
        else:
            held.update(new)
    return refused, held


@pytest.mark.parametrize("seed", [1, 2])
def test_span_decisions_equal_sequential_insert(spark, seed):
    random.seed(seed)
    stored = {(0, i): f"f{random.randint(0, 2)}" for i in range(4)}
    requests = [
        (f"r{n:03d}", [((0, random.randint(0, 25)), f"f{random.randint(0, 1)}") for _ in range(random.randint(1, 3))])
        for n in range(60)
    ]
    refused, held = _sequential(requests, stored)
    rows = [
        (key, [p], 10**18 + int(key[1:]), str(t), str(s), content)
        for key, items in requests
        for p, ((t, s), content) in enumerate(items)
    ]
    frame = spark.createDataFrame(
        rows, "request_key string, position array<bigint>, received_at_unix_nano bigint, trace_id string, span_id string, fingerprint string"
    )
    kept = spark.createDataFrame([(str(t), str(s), f) for (t, s), f in stored.items()], "trace_id string, span_id string, fingerprint string")
    new, out = dedup.accepted_spans(frame, kept, len(rows))
    assert {r.request_key for r in out.collect()} == refused
    got = {(int(r.trace_id), int(r.span_id)): r.fingerprint for r in new.collect()}
    assert got == {k: v for k, v in held.items() if k not in stored}


def test_packed_texts_come_back(spark):
    """Hexadecimal texts take half the room in exchanges; any other text comes back as it was and differs from all others."""
    texts = ["", "0", "00", "ab", "AB", "aB", "abc", "0abc", "zz", "\u00e4b", "\x00\x01", None, hashlib.sha256(b"x").hexdigest()]
    rows = spark.createDataFrame([(text, text) for text in texts], "text string, packed string")
    packed = dedup._packed(rows, "packed")
    assert packed.where("packed IS NOT NULL").select("packed").distinct().count() == len(texts) - 1
    assert packed.agg(F.max(F.octet_length("packed"))).first()[0] == 33
    assert all(row.text == row.packed for row in dedup._unpacked(packed, "packed").collect())


def test_first_copies_of_any_type(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 4, "c"), (2, 9, "d")], "key int, at int, text string")
    for frame in (rows, rows.withColumn("more", F.create_map("text", "at"))):
        got = {tuple(row[:3]) for row in dedup.first_copies(frame, ["key"], ["at"]).collect()}
        assert got == {(1, 4, "c"), (2, 9, "d")}
        assert dedup.first_copies(frame, ["key"], ["at"]).columns == frame.columns
    assert dedup.first_copies(rows.select("key", "at"), ["key"], ["at"]).count() == 2


@pytest.mark.parametrize("batch", [1, 7, 5000])
def test_size_retention_equals_sorting(spark, batch, monkeypatch):
    monkeypatch.setattr(retention, "FANOUT", 4)
    monkeypatch.setattr(retention, "COLLECTED", 3)
    random.seed(batch)
    keys = sorted({(random.choice([5, 5, 10**18, random.randint(0, 2**62)]), random.randint(0, 2), random.randint(-(2**62), 2**62)) for _ in range(300)})
    rows = [(*key, random.randint(1, 100)) for key in keys]
    frame = spark.createDataFrame(random.sample(rows, len(rows)), "received bigint, signal int, id bigint, bytes bigint")
    total = sum(r[3] for r in rows)
    for budget in (total // 3, total - 1, total) if batch == 7 else (total // 2,):
        evicted = 0
        while total - sum(r[3] for r in rows[:evicted]) > budget:
            evicted = min(evicted + batch, len(rows))
        mark = retention.size_mark(frame, budget, batch)
        kept = rows if mark is None else [r for r in rows if r[:3] >= tuple(mark)]
        assert kept == rows[evicted:]


def test_retention_config():
    assert retention.check_config(48, 0) == 512 << 20
    for hours, size in [(0, 0), (-1, 0), (10**9, 0), (48, 1000), (48, 3 << 30)]:
        with pytest.raises(ValueError):
            retention.check_config(hours, size)


def test_views_on_a_store(spark, folder, requests):
    store = Store.create(spark, folder)
    store.ingest(requests([otlp.log("a", traceId="1" * 32), otlp.log("b")]), LOGS)
    store.ingest(requests([otlp.spans((1, 1, "x"))]), SPANS)
    point = {"asInt": "5", "timeUnixNano": "20", "startTimeUnixNano": "10"}
    store.ingest(requests([otlp.metric("m", "sum", point, aggregationTemporality=1, isMonotonic=True)]), METRICS)
    filters = Filters(since="1h", now_nanos=10**18 + 60 * 10**9)
    rows = views.services(*store.tables().values(), filters).collect()
    assert [tuple(r)[:4] for r in rows] == [("shop", 2, 0, 1), ("unknown_service", 0, 1, 0)]
    assert views.trace(store.table(LOGS), store.table(SPANS), "1" * 32).count() == 1
    rate = views.metric_rate(store.table(METRICS), Filters(since="1h", name="m", now_nanos=10**18 + 10**9)).first()
    assert rate.rate_per_second == 5 / 1e-8 and rate.rate_reason is None
    plan = views.logs(store.table(LOGS), filters)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "received_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_no_budget_evicts_nothing(spark, folder, requests):
    store = Store.create(spark, folder, enforce_limits=False)
    store.ingest(requests([otlp.log(str(i)) for i in range(5)]), LOGS)
    assert set(store.evict_to_budget().values()) == {0}
    assert store.table(LOGS).count() == 5


def test_backfill_is_visible_until_the_next_pass(spark, folder, requests):
    store = Store.create(spark, folder)
    store.ingest(requests([otlp.log("new")], received=10**18), LOGS)
    now = 10**18 + 10 * HOUR
    assert store.expire_by_age(now_nanos=now)[LOGS] == 0
    old = 10**18 - 90 * HOUR
    assert store.ingest(requests([otlp.log("old")], received=old), LOGS).inserted == 1
    assert store.table(LOGS).count() == 2
    assert store.expire_by_age(now_nanos=now)[LOGS] == 1
    assert open_store(spark, folder).table(LOGS).count() == 1
    assert {r.signal: r.deleted for r in store.status().collect()}[LOGS] == 1


def test_failed_commit_stays_invisible(spark, folder, requests, monkeypatch):
    store = Store.create(spark, folder)

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("tracewell.sources.store._write_state", fail)
        with pytest.raises(OSError):
            store.ingest(requests([otlp.log("a")]), LOGS)
    store.ingest(requests([otlp.spans((1, 1, "x"))]), SPANS)
    assert open_store(spark, folder).table(LOGS).count() == 0
    assert store.ingest(requests([otlp.log("b"), otlp.log("c")]), LOGS).inserted == 2
    assert sorted(r.id for r in store.table(LOGS).collect()) == [1, 2]
    assert files.names(spark, f"{folder}/_staging") == []


def test_three_streams_into_one_store(spark, folder):
    point = {"asInt": "5", "timeUnixNano": "20", "startTimeUnixNano": "10"}
    texts = {
        LOGS: [otlp.log(str(i)) for i in range(9)],
        SPANS: [otlp.spans((1, i + 1, "x")) for i in range(9)],
        METRICS: [otlp.metric(f"m{i}", "sum", point, aggregationTemporality=1, isMonotonic=True) for i in range(9)],
    }
    store = Store.create(spark, f"{folder}/store")
    running = []
    for signal, lines in texts.items():
        spark.createDataFrame([(t,) for t in lines], "value string").repartition(3).write.text(f"{folder}/{signal}")
        arriving = stream_requests(spark, f"{folder}/{signal}", F.lit(10**18), max_files_per_trigger=1)
        running.append(ingest_stream(arriving, store, signal, f"{folder}/c-{signal}", signal, available_now=True))
    for query in running:
        query.awaitTermination()
    held = open_store(spark, f"{folder}/store")
    assert {signal: held.table(signal).count() for signal in texts} == dict.fromkeys(texts, 9)


def test_compaction_keeps_records(spark, folder, requests):
    store = Store.create(spark, folder)
    for i in range(3):
        store.ingest(requests([otlp.log(f"{i}-{n}") for n in range(4)], received=10**18 + i * HOUR, prefix=f"b{i}"), LOGS)
    store.expire_by_age(now_nanos=10**18 + 48 * HOUR + 2)
    before = sorted(map(str, store.table(LOGS).drop("batch").collect()))
    reader = open_store(spark, folder)
    assert store.compact(LOGS) == 3 and store.compact(LOGS) == 0
    assert sorted(map(str, store.table(LOGS).drop("batch").collect())) == before
    assert reader.table(LOGS).count() == len(before)
    assert store.ingest(requests([otlp.log("0-3")], received=10**18 + 3 * HOUR), LOGS).inserted == 0
    store.expire_by_age(now_nanos=10**18 + 48 * HOUR + 2)
    assert store.table(LOGS).count() == len(before)


def test_reset_and_sql_function(spark, folder, requests):
    store = Store.create(spark, folder)
    store.ingest(requests([otlp.log("a")]), LOGS)
    store.register_views()
    text = "SELECT resource_id(resource_attributes, resource_schema_url) AS r FROM otel_logs"
    from tracewell.functions.attributes import resource_id
    from tracewell.plans import page

    want = store.table(LOGS).select(resource_id(F.col("resource_attributes"), F.col("resource_schema_url"))).first()[0]
    assert page.sql(spark, text).first().r == want and len(want) == 32
    with pytest.raises(ValueError):
        store.reset(False, folder)
    store.reset(True, folder)
    with pytest.raises(StoreError):
        open_store(spark, folder)


def test_compaction_of_points_and_marks(spark, folder, requests):
    """Points are clustered by their name, and a mark that is raised during a compaction is not lost."""
    store = Store.create(spark, f"{folder}/points")
    for i in range(3):
        text = otlp.metric(f"m{i}", "sum", {"timeUnixNano": str(10**18 + i), "asInt": str(i)})
        store.ingest(requests([text], prefix=f"p{i}"), METRICS)
    assert store.compact(METRICS) == 3 and store.table(METRICS).count() == 3

    logs = Store.create(spark, f"{folder}/logs")
    for i in range(2):
        logs.ingest(requests([otlp.log(f"b{i}")], prefix=f"l{i}"), LOGS)
    other, write = logs.writer(), logs._write_batch

    def expired_meanwhile(*arguments):
        written = write(*arguments)
        assert other.expire_by_age(10**18 + 49 * HOUR)[LOGS] == 2
        return written

    logs._write_batch = expired_meanwhile
    with pytest.raises(StoreError):
        logs.compact(LOGS)
    assert logs.refresh().table(LOGS).count() == 0


def test_services_by_attributes(spark, folder, requests):
    store = Store.create(spark, folder)
    texts = [otlp.log("a", [("k", 1)]), otlp.log("b", [("k", 1)], [("service.name", "shop"), ("zone", "x")]), otlp.log("c", [("k", "1")])]
    store.ingest(requests(texts), LOGS)

    def counted(**filters):
        found = views.services(*store.tables().values(), Filters(since="1970-01-01T00:00:00Z", **filters)).collect()
        return [(r.service_name, r.logs, r.spans) for r in found]

    assert counted() == [("shop", 3, 0)]
    assert counted(attribute=["k=1"]) == [("shop", 2, 0)]
    assert counted(attribute=["k=1"], resource=["zone=x"]) == [("shop", 1, 0)]
    assert counted(resource=["zone=y"]) == []


def _scanned(frame):
    """Rows that the scans of a plan gave out."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookup_of_an_absent_value_reads_no_rows(spark, folder):
    """Values between the least and the largest one: only a Bloom filter can tell that they are absent."""
    from tracewell.model import TABLE_SCHEMAS

    made = spark.range(0, 60_000, numPartitions=2).select(F.md5(F.col("id").cast("string")).alias("trace_id"), "id")
    given = {"trace_id": F.col("trace_id"), "id": F.col("id"), "received_at_unix_nano": F.lit(1_700_000_000 * 10**9)}
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLE_SCHEMAS[SPANS]]
    store = Store.create(spark, f"{folder}/store")
    store._write_batch(made.select(columns), SPANS, 1)
    store.state.batches[SPANS].append(1)
    spans = store.table(SPANS)
    absent = [hashlib.md5(f"absent {i}".encode()).hexdigest() for i in range(3)]
    assert [_scanned(spans.where(F.col("trace_id") == value)) for value in absent] == [0, 0, 0]
    present = spans.where(F.col("trace_id") == hashlib.md5(b"77").hexdigest())
    assert [r.id for r in present.select("id").collect()] == [77]
    assert 0 < _scanned(present) < 60_000


def test_status_history_of_a_stream_into_a_store(spark, folder):
    texts = spark.createDataFrame([(otlp.log(str(i)),) for i in range(12)], "value string")
    texts.repartition(3).write.text(f"{folder}/in")
    store = Store.create(spark, f"{folder}/store")
    arriving = stream_requests(spark, f"{folder}/in", F.lit(10**18), max_files_per_trigger=1)
    ingest_stream(
        arriving, store, LOGS, f"{folder}/checkpoint", "logs", available_now=True, history=f"{folder}/history"
    ).awaitTermination()
    rows = history(spark, f"{folder}/history").orderBy("id").collect()
    assert len(rows) == 3 and rows[-1].committed_logs == 12 and {r.process for r in rows} == {"logs"}
    assert [r.committed_logs for r in rows] == sorted(r.committed_logs for r in rows)
    # One snapshot an interval, so each of them is reported.
    spread = history(spark, f"{folder}/history").withColumn("time_unix_nano", F.col("id") * 20 * 10**9)
    reports = status.activity(spread).orderBy("reported_at").collect()
    assert sum(r.logs_written for r in reports) == 12 - rows[0].committed_logs and reports[-1].logs_total == 12


def test_observed_counters_become_status_history(spark, folder):
    row = "fingerprint string, payload_bytes bigint, received_at_unix_nano bigint"
    records = spark.createDataFrame([(str(i % 5), 10, 10**18 + i) for i in range(8)], row)
    records.repartition(2).write.parquet(f"{folder}/in")
    listener = StatusHistory(spark, f"{folder}/history", "p", {"records": "committed_logs"})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        writer = observed_counts(deduplicate(stream, LOGS), "records").writeStream.format("noop").outputMode("append")
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 30
        # Reports come after the query has ended, and a row is there once it is written.
        while time.time() < until:
            if files.exists(spark, f"{folder}/history") and history(spark, f"{folder}/history").where("committed_logs = 5").count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = history(spark, f"{folder}/history").orderBy("id").collect()
    assert rows[-1].committed_logs == 5 and len(rows) >= 2 and all(r.pipeline_ready for r in rows)
    with pytest.raises(ValueError):
        StatusHistory(spark, folder, "p", {"records": "committed"})


def test_json_each(spark, folder):
    Store.create(spark, folder).register_views()
    text = """SELECT t.id, a.* FROM VALUES (1, '[{"k":1},2,"x",null,true]'), (2, '{"k":1.5,"z":[1]}'), (3, 'bad'), (4, NULL), (5, '{}'), (6, '7')
              AS t(id, j), LATERAL json_each(t.j) AS a"""
    rows = {tuple(r) for r in page.sql(spark, text).collect()}
    assert rows == {
        (1, "0", '{"k":1}', "object"), (1, "1", "2", "bigint"), (1, "2", "x", "string"), (1, "3", None, "void"),
        (1, "4", "true", "boolean"), (2, "k", "1.5", "decimal"), (2, "z", "[1]", "array"),
    }
    # One pass over the rows: no join with the distinct documents.
    plan = page.sql(spark, text)._jdf.queryExecution().executedPlan().toString()
    assert "Generate variant_explode" in plan and "Join" not in plan


def test_sketches_estimate_discovery(spark):
    points = derived.metric_points(spark, "/root/testdata/sf0.01")
    sketches = discovery.daily_sketches(points)
    assert sketches.select("received_date").distinct().count() > 20
    got = {tuple(r[name] for name in METRIC_IDENTITY): r for r in discovery.metric_list_estimated(sketches).collect()}
    exact = views.metric_list(points, Filters(since="1970-01-01T00:00:00Z"), ordered=False).collect()
    assert len(got) == len(exact)
    for r in exact:
        e = got[tuple(r[name] for name in METRIC_IDENTITY)]
        same = ["point_count", "no_recorded_value_count", "first_time", "last_time", "last_received_at"]
        assert [e[name] for name in same] == [r[name] for name in same]
        # Four standard errors, and exact where the sketch still lists its entries.
        assert abs(e.series_count - r.series_count) <= max(4 * 1.04 / 64 * r.series_count, 0.5)


def test_size_retention_derives_its_tables_once(spark):
    """What is kept comes from the written tables; the join of the spans does not run again for it."""
    from workload import queries

    for name in ("retention_size", "retention_size_batched"):
        kept = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert not [file for file in kept.inputFiles() if "/root/testdata" in file]
