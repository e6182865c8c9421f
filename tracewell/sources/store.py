"""The telemetry store: three Parquet tables and a small state file.

``<root>/_state/<version>.json`` lists the committed folders of each signal, the retention marks and the next ids.
``<root>/g<generation>/<signal>/batch=<n>/received_date=<d>`` holds rows; every attempt to append has a folder of its own,
and only folders that the state lists are read. A retention mark applies to the batches that were there when it was
raised, so records that come in later are visible until the next pass. Nothing is changed in place.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.times import receipt_date
from tracewell.model import LOGS, METRICS, SIGNALS, SPANS, TABLE_SCHEMAS, missing_columns
from tracewell.operators import dedup, ingest, retention
from tracewell.operators.retention import Mark
from tracewell.sources import files

FORMAT_VERSION = 2
KEPT_STATES = 10
REJECTED = "rejected"
# The SQL form of ``attributes.resource_id``.
RESOURCE_ID_FUNCTION = """
  CREATE OR REPLACE TEMPORARY FUNCTION resource_id(attributes STRING, schema_url STRING) RETURNS STRING
  RETURN substring(sha2(concat('[', btrim(to_json(array(attributes)), '[]'), ',',
                               btrim(to_json(array(schema_url)), '[]'), ']'), 256), 1, 32)"""
# Members of a JSON object, or elements of an array by position, as rows; nothing for other values and broken texts.
JSON_EACH_FUNCTION = """
  CREATE OR REPLACE TEMPORARY FUNCTION json_each(document STRING)
  RETURNS TABLE (key STRING, value STRING, type STRING)
  RETURN SELECT coalesce(e.key, CAST(e.pos AS STRING)), CAST(e.value AS STRING),
                lower(regexp_extract(schema_of_variant(e.value), '^[A-Z]+', 0))
         FROM variant_explode(try_parse_json(document)) AS e"""
COMMIT_TRIES = 20
# Columns that are looked up by value, and the distinct values a file is expected to hold: Bloom filters are sized for them.
LOOKUPS = {
    LOGS: {"trace_id": 1_000_000, "fingerprint": 1_000_000},
    SPANS: {"trace_id": 1_000_000},
    METRICS: {"metric_name": 10_000, "fingerprint": 1_000_000},
}
MAX_FILTER_BYTES = 2 << 20
_ATTEMPTS = 1 << 20  # room for the random part of a batch number


class StoreError(RuntimeError):
    """The folder holds no store that this version can read."""


@dataclass(frozen=True)
class State:
    version: int = 0
    format: int = FORMAT_VERSION
    generation: int = 1
    batches: dict[str, list[int]] = field(default_factory=lambda: {name: [] for name in (*SIGNALS, REJECTED)})
    last_batch: int = 0
    next_id: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SIGNALS, 1))
    marks: list[list[int]] = field(default_factory=list)  # received, signal, id, and the last batch it applies to
    retention_hours: int = retention.DEFAULT_HOURS
    max_bytes: int = retention.DEFAULT_BYTES  # 0: no budget
    committed: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SIGNALS, 0))
    deleted: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SIGNALS, 0))
    rejected: int = 0
    replaced: list[str] = field(default_factory=list)  # folders that a later commit deletes
    streams: dict[str, int] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(
        default_factory=lambda: {name: schema.names for name, schema in TABLE_SCHEMAS.items()}
    )


@dataclass(frozen=True)
class Appended:
    inserted: int
    refused: int


def _stored_schema(signal: str) -> T.StructType:
    schema = T.StructType(list(TABLE_SCHEMAS[signal]))
    return schema.add("batch", T.LongType()).add("received_date", T.DateType())


class Reader:
    """Read-only access. Never creates, repairs or changes anything."""

    def __init__(self, spark: SparkSession, root: str, state: State):
        self.spark, self.root, self.state = spark, root, state

    def table(self, signal: str) -> DataFrame:
        """Visible rows of a signal; a lazy scan that prunes columns and partitions."""
        schema = _stored_schema(signal)
        batches = self.state.batches[signal]
        if not batches:
            return self.spark.createDataFrame([], schema)
        path = self._path(signal)
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in batches])
        for *key, until in self.state.marks:
            if min(batches) <= until:
                rows = rows.where((F.col("batch") > until) | retention.condition(signal, Mark(*key), dated=True))
        return rows

    def tables(self) -> dict[str, DataFrame]:
        return {signal: self.table(signal) for signal in SIGNALS}

    def register_views(self) -> None:
        """Make the tables, and the functions ``resource_id`` and ``json_each``, available to ad-hoc SQL under their names."""
        self.spark.sql(RESOURCE_ID_FUNCTION)
        self.spark.sql(JSON_EACH_FUNCTION)
        for signal, table in self.tables().items():
            table.createOrReplaceTempView(signal)

    def status(self) -> DataFrame:
        """Per signal: rows and bytes held, oldest receipt (0 if none), lifetime counters."""
        oldest = F.coalesce(F.min("received_at_unix_nano"), F.lit(0)).cast("bigint")
        parts = None
        for signal, table in self.tables().items():
            part = table.agg(
                F.count(F.lit(1)).alias("stored"),
                F.coalesce(F.sum("payload_bytes"), F.lit(0)).cast("bigint").alias("bytes"),
                oldest.alias("oldest_received_at"),
            ).select(
                F.lit(signal).alias("signal"),
                "*",
                F.lit(self.state.committed[signal]).cast("bigint").alias("committed"),
                F.lit(self.state.deleted[signal]).cast("bigint").alias("deleted"),
            )
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def _path(self, signal: str) -> str:
        return f"{self.root}/g{self.state.generation}/{signal}"


def open_store(spark: SparkSession, root: str) -> Reader:
    """Open an existing store for reading; refuses missing, foreign or stale ones."""
    root = root.rstrip("/")
    return Reader(spark, root, _load_state(spark, root))


def _load_state(spark: SparkSession, root: str) -> State:
    versions = [name for name in files.names(spark, f"{root}/_state") if name.endswith(".json")]
    if not versions:
        raise StoreError(f"no telemetry store at {root}")
    try:
        values = json.loads(files.read_text(spark, f"{root}/_state/{max(versions)}"))
        state = State(**values)
    except (ValueError, TypeError, KeyError) as error:
        raise StoreError(f"{root} is not a telemetry store: {error}") from None
    if state.format != FORMAT_VERSION:
        raise StoreError(f"store format {state.format} is not {FORMAT_VERSION}")
    for signal in SIGNALS:
        missing = missing_columns(signal, state.columns.get(signal, []))
        if missing:
            raise StoreError(f"{signal} lacks columns: {', '.join(missing)}")
    return state


class Store(Reader):
    """A store that can be written. One writer per signal at a time; a second one fails on commit."""

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        root: str,
        retention_hours: int = retention.DEFAULT_HOURS,
        max_bytes: int = 0,
        enforce_limits: bool = True,
    ) -> Store:
        """Create an empty store, or open the existing one at ``root``.

        ``enforce_limits=False`` lifts the bounds of the budget, which are those of a single machine; a budget of 0
        then means that there is none.
        """
        budget = retention.check_config(retention_hours, max_bytes) if enforce_limits else max_bytes
        root = root.rstrip("/")
        if not files.names(spark, f"{root}/_state"):
            state = State(version=1, retention_hours=retention_hours, max_bytes=budget)
            _write_state(spark, root, state)
        return cls(spark, root, _load_state(spark, root))

    def refresh(self) -> Store:
        self.state = _load_state(self.spark, self.root)
        return self

    def writer(self, spark: SparkSession | None = None) -> Store:
        """Another writer of the same store, with the state of now; in another session if one is given."""
        return Store(spark or self.spark, self.root, _load_state(self.spark, self.root))

    def _commit(self, change: Callable[[State], dict], signal: str | None = None) -> None:
        """Create the next state from the newest one.

        Writers of other signals may have committed meanwhile; then the change is applied to what they left. A change
        that rests on the rows of ``signal`` fails if those are no longer the rows it has seen.
        """
        for _ in range(COMMIT_TRIES):
            newest = _load_state(self.spark, self.root)
            seen = (self.state.generation, signal and self.state.batches[signal])
            if seen != (newest.generation, signal and newest.batches[signal]):
                raise StoreError(f"another writer has changed {signal or 'the store'}; refresh and try again")
            state = replace(newest, version=newest.version + 1, **change(newest))
            try:
                _write_state(self.spark, self.root, state)
            except Exception:
                if not files.exists(self.spark, _state_path(self.root, state.version)):
                    raise
                time.sleep(random.random() / 10)
                continue
            self.state = state
            old = state.version - KEPT_STATES
            if old > 0:
                files.delete(self.spark, _state_path(self.root, old))
            return
        raise StoreError("too many writers commit at once")

    # --- Writing --------------------------------------------------------------------

    def ingest(
        self,
        requests: DataFrame,
        signal: str,
        keys: ingest.ContextKeys = ingest.ContextKeys(),
        stream: tuple[str, int] | None = None,
    ) -> Appended:
        """Validate, deduplicate and append one batch of export requests.

        ``stream`` is (query name, micro-batch id): a micro-batch that was committed
        before is skipped, which makes replays after a failure exact.
        """
        if stream and self.state.streams.get(stream[0], -1) >= stream[1]:
            return Appended(0, 0)
        # The requests are parsed once; all later steps read the written columns, and a
        # lost executor costs no second parse.
        staging = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            return self._ingest(requests, signal, keys, stream, staging)
        finally:
            files.delete(self.spark, staging)

    def _ingest(self, requests: DataFrame, signal: str, keys, stream: tuple[str, int] | None, staging: str) -> Appended:
        outcome = ingest.outcome(ingest.build_requests(requests, signal), signal, keys)
        outcome.write.parquet(f"{staging}/parsed", compression="zstd")
        staged = self.spark.read.schema(outcome.schema).parquet(f"{staging}/parsed")
        rows = staged.where("reason IS NULL").drop("reason")
        rows = rows.where(F.assert_true(ingest.storable(signal)).isNull())
        large = ingest.oversized(rows)
        refused = staged.where("reason IS NOT NULL").select("request_key", "received_at_unix_nano", "reason")
        if not large.isEmpty():
            refused = refused.unionByName(_refused(rows, large, "stored payload is larger than 64 MiB"))
            rows = rows.join(large, "request_key", "left_anti")
        count = rows.count()
        stored = self.table(signal)
        if signal == SPANS:
            fresh, conflicting = dedup.accepted_spans(rows, stored, count, f"{staging}/conflicts")
            reason = "a stored span of this identity has other content"
            refused = refused.unionByName(_refused(rows, conflicting, reason))
        else:
            order = ["received_at_unix_nano", "request_key", "position"]
            copies = dedup.first_copies(rows, ["fingerprint"], order)
            fresh = dedup.unseen(copies, stored, ["fingerprint"], count)
        return self._append(fresh, signal, refused, stream, staging)

    def _numbered(self, rows: DataFrame, signal: str, staging: str) -> tuple[DataFrame, int]:
        """``rows`` with ids without gaps in the order of arrival, and their number."""
        arrival = ["received_at_unix_nano", "request_key", "position"]
        place = F.monotonically_increasing_id()
        sorted_rows = rows.drop("id").repartitionByRange(*arrival).sortWithinPartitions(*arrival)
        sorted_rows = sorted_rows.withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND(2**33 - 1))
        sorted_rows.write.parquet(f"{staging}/sorted", compression="zstd")
        written = self.spark.read.schema(sorted_rows.schema).parquet(f"{staging}/sorted")
        # One row for each partition that was written.
        sizes = sorted(written.groupBy("_part").count().collect())
        total, starts = 0, []
        for part, size in sizes:
            starts.append((part, total))
            total += size
        first = self.spark.createDataFrame(starts, "_part long, _start long")
        number = F.col("_start") + F.col("_row") + F.lit(self.state.next_id[signal])
        return written.join(F.broadcast(first), "_part").withColumn("id", number.cast("bigint")), total

    def _new_batch(self) -> int:
        """A batch number above all committed ones, which no other attempt has."""
        return (self.state.last_batch // _ATTEMPTS + 1) * _ATTEMPTS + random.SystemRandom().randrange(_ATTEMPTS)

    def _write_batch(self, rows: DataFrame, signal: str, number: int) -> None:
        dated = rows.select(*TABLE_SCHEMAS[signal].names).withColumn("received_date", receipt_date(F.col("received_at_unix_nano")))
        options = bloom_filters(LOOKUPS[signal])
        dated.write.options(**options).partitionBy("received_date").parquet(f"{self._path(signal)}/batch={number}", compression="zstd")

    def _append(
        self, rows: DataFrame, signal: str, refused: DataFrame, stream: tuple[str, int] | None, staging: str
    ) -> Appended:
        number = self._new_batch()
        numbered, total = self._numbered(rows, signal, staging)
        if total:
            self._write_batch(numbered, signal, number)
        refused.write.parquet(f"{self._path(REJECTED)}/batch={number}")
        bad = self.spark.read.schema(refused.schema).parquet(f"{self._path(REJECTED)}/batch={number}").count()

        def change(state: State) -> dict:
            return {
                "batches": {
                    **state.batches,
                    **({signal: [*state.batches[signal], number]} if total else {}),
                    **({REJECTED: [*state.batches[REJECTED], number]} if bad else {}),
                },
                "last_batch": max(state.last_batch, number),
                "next_id": {**state.next_id, signal: state.next_id[signal] + total},
                "committed": {**state.committed, signal: state.committed[signal] + total},
                "rejected": state.rejected + bad,
                "streams": {**state.streams, **({stream[0]: stream[1]} if stream else {})},
            }

        self._commit(change, signal)
        return Appended(total, bad)

    def compact(self, signal: str, cluster: list[str] | None = None) -> int:
        """Rewrite the visible rows of a signal as one batch, clustered by trace or metric and service.

        Lookups by these columns then skip files by their statistics. Ids and results stay the same. Returns the number
        of batches that were replaced; their folders go with the next compaction or retention pass, so that readers
        which have opened the store before are not disturbed.
        """
        before = self.state.batches[signal]
        if len(before) < 2:
            return 0
        number = self._new_batch()
        order = cluster or {METRICS: ["metric_name", "service_name"]}.get(signal, ["trace_id", "service_name"])
        self._write_batch(self.table(signal).repartitionByRange(*order).sortWithinPartitions(*order), signal, number)
        done, marks = list(self.state.replaced), self.state.marks

        def change(state: State) -> dict:
            if state.marks != marks:
                # The new batch would escape a mark that was raised after its rows were read.
                raise StoreError("records have expired meanwhile; refresh and try again")
            gone = [f"{self._path(signal)}/batch={n}" for n in before]
            return {
                "batches": {**state.batches, signal: [number]},
                "last_batch": max(state.last_batch, number),
                "replaced": [path for path in state.replaced if path not in done] + gone,
            }

        self._commit(change, signal)
        for path in done:
            files.delete(self.spark, path)
        return len(before)

    # --- Retention ------------------------------------------------------------------

    def expire_by_age(self, now_nanos: int | None = None) -> dict[str, int]:
        """Expire records received before the retention period; returns counts per signal."""
        now = time.time_ns() if now_nanos is None else now_nanos
        return self._raise_mark(retention.age_mark(now, self.state.retention_hours))

    def evict_to_budget(self, max_bytes: int | None = None, batch: int = retention.EVICTION_BATCH) -> dict[str, int]:
        """Evict the globally oldest records until the payloads fit the budget."""
        budget = self.state.max_bytes if max_bytes is None else max_bytes
        if not budget:
            return dict.fromkeys(SIGNALS, 0)
        mark = retention.size_mark(retention.keys(self.tables()), budget, batch)
        return dict.fromkeys(SIGNALS, 0) if mark is None else self._raise_mark(mark)

    def _raise_mark(self, mark: Mark) -> dict[str, int]:
        """Hide all present records below ``mark``; returns how many those are."""
        gone = {
            signal: table.where(~retention.condition(signal, mark, dated=False)).count()
            for signal, table in self.tables().items()
        }
        until, done = self.state.last_batch, list(self.state.replaced)

        def change(state: State) -> dict:
            # A mark that another one covers, in key and batch, is not needed any more.
            marks = [*state.marks, [*mark, until]]
            needed = [m for m in marks if not any(o != m and o[:3] >= m[:3] and o[3] >= m[3] for o in marks)]
            return {
                "marks": [m for i, m in enumerate(needed) if m not in needed[:i]],
                "deleted": {signal: state.deleted[signal] + gone[signal] for signal in SIGNALS},
                "replaced": [path for path in state.replaced if path not in done],
            }

        if any(gone.values()) or done:
            self._commit(change)
        for path in done:
            files.delete(self.spark, path)
        self._drop_old_dates()
        return gone

    def _drop_old_dates(self) -> None:
        """Delete the folders of dates that lie wholly below a mark of their batch."""
        oldest = [(until, time.strftime("%Y-%m-%d", time.gmtime(max(key[0], 0) // 10**9))) for *key, until in self.state.marks]
        for path in files.matching(self.spark, f"{self.root}/g{self.state.generation}/otel_*/batch=*/received_date=*"):
            batch, date = (part.split("=", 1)[1] for part in path.rsplit("/", 2)[1:])
            if any(int(batch) <= until and date < first for until, first in oldest):
                files.delete(self.spark, path)

    def _counts(self) -> dict[str, int]:
        return {signal: table.count() for signal, table in self.tables().items()}

    def clear(self, confirm: bool, expected_path: str) -> dict:
        """Remove all records of all signals at once; identical data may be ingested again."""
        self._check_confirmed(confirm, expected_path)
        deleted = self._counts()
        old = self.state.generation

        def change(state: State) -> dict:
            return {
                "generation": old + 1,
                "batches": {name: [] for name in state.batches},
                "marks": [],
                "replaced": [],
                "deleted": {signal: state.deleted[signal] + deleted[signal] for signal in SIGNALS},
            }

        self._commit(change)
        files.delete(self.spark, f"{self.root}/g{old}")
        return {
            "path": self.root,
            "cleared_at_unix_nano": time.time_ns(),
            "logs": deleted[LOGS],
            "spans": deleted[SPANS],
            "metric_points": deleted[METRICS],
        }

    def reset(self, confirm: bool, expected_path: str) -> None:
        """Delete the whole store, its state included."""
        self._check_confirmed(confirm, expected_path)
        files.delete(self.spark, self.root)

    def _check_confirmed(self, confirm: bool, expected_path: str) -> None:
        if not confirm:
            raise ValueError("removing the records of a store needs confirmation")
        if expected_path.rstrip("/") != self.root:
            raise ValueError(f"this store is {self.root} and not {expected_path}")

    def rejected_requests(self) -> DataFrame:
        """Quarantined requests with the reason they were refused."""
        path = self._path(REJECTED)
        schema = "request_key string, received_at_unix_nano bigint, reason string, batch bigint"
        batches = self.state.batches[REJECTED]
        if not batches:
            return self.spark.createDataFrame([], schema)
        folders = [f"{path}/batch={n}" for n in batches]
        return self.spark.read.schema(schema).option("basePath", path).parquet(*folders)


def bloom_filters(distinct: dict[str, int]) -> dict[str, str]:
    """Writer options for a Bloom filter on each column, by the number of distinct values a row group is expected to hold.

    A filter takes ``MAX_FILTER_BYTES`` at most. Lookups by equality skip the row groups whose filter excludes the value.
    """
    options = {"parquet.bloom.filter.max.bytes": str(MAX_FILTER_BYTES), "parquet.bloom.filter.adaptive.enabled": "true"}
    for column, values in distinct.items():
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{column}"] = str(values)
    return options


def _refused(rows: DataFrame, keys: DataFrame, reason: str) -> DataFrame:
    """Refused requests among ``rows`` in the form of the quarantine table."""
    return (
        rows.join(keys, "request_key", "left_semi")
        .groupBy("request_key")
        .agg(F.min("received_at_unix_nano").alias("received_at_unix_nano"))
        .withColumn("reason", F.lit(reason))
    )


def _state_path(root: str, version: int) -> str:
    return f"{root}/_state/{version:012d}.json"


def _write_state(spark: SparkSession, root: str, state: State) -> None:
    files.create_text(spark, _state_path(root, state.version), json.dumps(asdict(state), sort_keys=True))
