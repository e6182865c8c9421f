"""Retention by age and by size.

Both remove the oldest records of all signals in order of (receipt, signal, id). What
remains is therefore always everything from one key on, so retention is one key to find
and one predicate to apply; nothing is rewritten.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.times import receipt_date
from tracewell.model import SIGNALS

# Retention limits and defaults.
DEFAULT_HOURS = 48
DEFAULT_BYTES = 512 << 20
MIN_BYTES = 1 << 20
MAX_BYTES = (3 << 30) - (64 << 20)
EVICTION_BATCH = 5_000
HOUR_NANOS = 3_600_000_000_000

FANOUT = 65_536  # buckets per step of the search
COLLECTED = 65_536  # keys that the last step may bring to the driver


class Mark(NamedTuple):
    """The lowest key that is kept."""

    received: int = 0
    signal: int = 0
    id: int = 0


def check_config(hours: int, max_bytes: int) -> int:
    """Validate retention settings and return the byte budget; 0 means the default."""
    budget = max_bytes or DEFAULT_BYTES
    if not MIN_BYTES <= budget <= MAX_BYTES:
        raise ValueError(f"max_bytes must be between {MIN_BYTES} and {MAX_BYTES}")
    if hours <= 0 or hours > (2**63 - 1) // HOUR_NANOS:
        raise ValueError("retention hours must be positive and fit in a duration")
    return budget


def age_mark(now_nanos: int, hours: int = DEFAULT_HOURS) -> Mark:
    """Mark that expires everything received more than ``hours`` ago; event time is ignored."""
    return Mark(now_nanos - hours * HOUR_NANOS, 0, -(2**63))


def condition(signal: str, mark: Mark, dated: bool) -> Column:
    """Whether the mark keeps a row of a signal table; ``dated`` tables are partitioned by receipt date."""
    received = F.col("received_at_unix_nano")
    own = SIGNALS.index(signal)
    if own > mark.signal:
        keeps = received >= mark.received
    elif own < mark.signal:
        keeps = received > mark.received
    else:
        keeps = (received > mark.received) | ((received == mark.received) & (F.col("id") >= mark.id))
        # Implied, but in a form that Parquet statistics can use.
        keeps = (received >= mark.received) & keeps
    if dated:
        keeps = (F.col("received_date") >= receipt_date(F.lit(max(mark.received, 0)))) & keeps
    return keeps


def kept(table: DataFrame, signal: str, mark: Mark) -> DataFrame:
    """Rows of a signal table that the mark keeps."""
    return table.where(condition(signal, mark, "received_date" in table.columns))


def keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Retention keys and sizes of all signals: received, signal, id, bytes."""
    combined = None
    for number, signal in enumerate(SIGNALS):
        if signal in tables:
            part = tables[signal].select(
                F.col("received_at_unix_nano").alias("received"),
                F.lit(number).alias("signal"),
                "id",
                F.col("payload_bytes").alias("bytes"),
            )
            combined = part if combined is None else combined.unionByName(part)
    return combined


def size_mark(records: DataFrame, budget: int, batch: int = EVICTION_BATCH) -> Mark | None:
    """Mark that brings the total of ``bytes`` down to the budget; None if it already fits.

    Evicts whole batches of the globally oldest records. The key is found by narrowing
    one range: each step sums at most ``FANOUT`` buckets on the executors and reads only
    the range that the step before has chosen. No step sorts the records.
    """
    total = records.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    excess = (total.bytes or 0) - budget
    if excess <= 0:
        return None
    cut, rank = _reach(records, "bytes", excess)
    wanted = min(-(-rank // batch) * batch, total.rows)
    if wanted != rank:
        cut, _ = _reach(records, "rows", wanted)
    return Mark(cut.received, cut.signal, cut.id + 1)


def _reach(records: DataFrame, measure: str, target: int) -> tuple[Mark, int]:
    """The key at which the running sum of bytes or rows reaches ``target``, and its rank."""
    before = {"bytes": 0, "rows": 0}
    scope = records

    def pass_until_reached(groups) -> dict:
        for group in groups:
            if before[measure] + group[measure] >= target:
                return group
            before["bytes"] += group["bytes"]
            before["rows"] += group["rows"]
        raise ValueError("the records hold less than the target")

    for name in ("received", "signal", "id"):
        bounds = scope.agg(F.min(name).alias("low"), F.max(name).alias("high")).first()
        low, high = bounds.low, bounds.high
        while True:
            width = (high - low) // FANOUT + 1
            within = scope.where(F.col(name).between(low, high))
            # Ids use all 64 bits, so the distance needs more than a bigint.
            distance = F.col(name).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
            bucket = F.call_function("div", distance, F.lit(width).cast("decimal(20,0)"))
            sums = (
                within.groupBy(bucket.alias("bucket"))
                .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
                .orderBy("bucket")
                .collect()
            )
            chosen = pass_until_reached(sums)
            low = low + int(chosen["bucket"]) * width
            high = min(low + width - 1, high)
            scope = scope.where(F.col(name).between(low, high))
            if chosen["rows"] <= COLLECTED:
                last = scope.select("received", "signal", "id", "bytes", F.lit(1).alias("rows"))
                key = pass_until_reached(last.orderBy("received", "signal", "id").collect())
                return Mark(key["received"], key["signal"], key["id"]), before["rows"] + 1
            if width == 1:
                break
    raise ValueError("retention keys are not unique")
