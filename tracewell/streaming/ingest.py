"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.model import LOGS, METRICS, SPANS
from tracewell.operators.dedup import SPAN_IDENTITY
from tracewell.operators.ingest import ContextKeys
from tracewell.session import shuffles_dropped
from tracewell.sources.store import Store
from tracewell.streaming.activity import snapshot

RECORD_KEY = {LOGS: ["fingerprint"], METRICS: ["fingerprint"], SPANS: SPAN_IDENTITY}


def ingest_stream(
    requests: DataFrame,
    store: Store,
    signal: str,
    checkpoint: str,
    name: str,
    available_now: bool = False,
    interval: str = "10 seconds",
    keys: ContextKeys = ContextKeys(),
    history: str | None = None,
    tasks: int | None = None,
) -> StreamingQuery:
    """Append every micro-batch of requests to the store, each exactly once.

    The store remembers the last micro-batch of ``name``, so one that is replayed after a
    failure adds nothing; copies across micro-batches are found in the store itself, which
    makes the retention period the horizon of deduplication. With ``history``, the folder of a status history, the
    counters of the store are added to it after each micro-batch, with ``name`` as the process. With ``tasks``, the requests
    of a micro-batch are dealt over so many tasks first: compressed files cannot be split, and their size says little of
    the work in them. What a micro-batch stages and shuffles is gone before the next one begins.
    """

    def commit(batch: DataFrame, number: int) -> None:
        # A writer of its own, in the session of this stream: others may commit to the same store meanwhile.
        writer = store.writer(batch.sparkSession)
        with shuffles_dropped(batch.sparkSession):
            writer.ingest(batch.repartition(tasks) if tasks else batch, signal, keys, stream=(name, number))
            if history:
                snapshot(writer, name).coalesce(1).write.mode("append").parquet(history)

    writer = requests.writeStream.foreachBatch(commit).queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def deduplicate(records: DataFrame, signal: str, retention_hours: int = 48) -> DataFrame:
    """First copies of streamed records, for sinks other than the store.

    The watermark runs on receipt time: event time never makes a record late, and a copy
    that arrives after the retention period counts as new again.
    """
    received = F.timestamp_micros(F.call_function("div", F.col("received_at_unix_nano"), F.lit(1000)))
    return (
        records.withColumn("_received", received)
        .withWatermark("_received", f"{retention_hours} hours")
        .dropDuplicatesWithinWatermark(RECORD_KEY[signal])
        .drop("_received")
    )
