"""Counter rates over a stream of metric points.

State keyed by buckets of series holds points until they are older than the reorder delay, puts them in order and joins each with the one
before; the rules are the same columns as in the batch operator. Points that have been rated stay in state for the
correction period. A point that arrives within it is rated late, and each neighbour whose rate it changes is given out
again with the next ``revision``; :func:`latest` keeps the newest revision of each point. Points later than both periods
are only seen by the batch operator, which reads the full history.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.model import SERIES_IDENTITY
from tracewell.operators.rate import POINT_FIELDS, PREVIOUS_COLUMNS, classify

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 1024

# Integers travel as text: in pandas, an integer column with missing values loses digits.
_CARRIED = ["id", "received_at_unix_nano", *SERIES_IDENTITY, *POINT_FIELDS]
_FLAGS = {"same_time", "previous_same_time"}
# A point in state; what identifies its series is kept once beside all points of the series.
_POINT = ["id", *POINT_FIELDS, "received_at_unix_nano"]
_ID, _TIME = _POINT.index("id"), _POINT.index("time_unix_nano")
_FIELDS = [_POINT.index(name) for name in POINT_FIELDS]


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


_PACKED = T.StructType([T.StructField("packed", T.BinaryType())])
_LAST = _strings([*POINT_FIELDS, "same_time"])
_OUTPUT = _strings(["series", *_POINT, "same_time", *PREVIOUS_COLUMNS, "revision", *SERIES_IDENTITY])


def _pack(content) -> tuple[bytes]:
    return (zlib.compress(json.dumps(content, separators=(",", ":")).encode(), 1),)


def _unpack(row: tuple):
    return json.loads(zlib.decompress(row[0]))


class PreviousPoints(StatefulProcessor):
    """Emits each point with its previous point, and again when a late point changes what it was given.

    A state key is a bucket of series: each call to the state moves many points, packed as one value.
    """

    def __init__(self, correction: int = 0, idle: int | None = None):
        self.correction, self.idle = correction, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Each value: the identities of series, and rows of (series, point); in recent, the revision last.
        self.waiting = handle.getListState("waiting", _PACKED)
        self.recent = handle.getListState("recent", _PACKED)
        self.last = handle.getValueState("last", _PACKED)
        # Buckets that this micro-batch has settled. Input comes before timers, so another timer finds nothing new.
        self.settled = set()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = _unpack(tuple(self.last.get())) if self.last.exists() else {}
        cells = initialState[["series", *_LAST.names]].astype(object)
        for series, *row in cells.where(cells.notna(), None).itertuples(index=False, name=None):
            last[series] = row
        self.last.update(_pack(last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            cells = frame[["series", *_POINT, *SERIES_IDENTITY]].astype(object)
            cells = cells.where(cells.notna(), None).itertuples(index=False, name=None)
            names, points = {}, []
            for series, *row in cells:
                names[series] = row[len(_POINT) :]
                points.append((series, row[: len(_POINT)]))
            if points:
                self.waiting.appendValue(_pack([names, points]))
                earliest = min(_millis(point) for _, point in points)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.settled:
            return
        self.settled.add(key)
        watermark = timerValues.getCurrentWatermarkInMs()
        names, waiting, recent = {}, defaultdict(list), defaultdict(list)
        for state, rows in ((self.waiting, waiting), (self.recent, recent)):
            for packed in state.get():
                found, points = _unpack(tuple(packed))
                names.update(found)
                for series, point, *revision in points:
                    rows[series].append((*point, *revision))
        last = _unpack(tuple(self.last.get())) if self.last.exists() else {}
        out, held, kept = [], [], []
        for series in waiting.keys() | recent.keys():
            out += [(*row, *names[series]) for row in self._settle(series, waiting[series], recent[series], last, watermark, held, kept)]
        self._put(self.waiting, names, held)
        if held:
            self._wake(min(_millis(point) for _, point in held))
        self._put(self.recent, names, kept)
        if kept:
            self.handle.registerTimer(min(_millis(point) for _, point, _ in kept) + 1)
        if self.idle is not None:
            busy = {row[0] for row in [*held, *kept]}
            ends = {series: int(row[0]) // 1_000_000 + self.idle for series, row in last.items() if series not in busy}
            last = {series: row for series, row in last.items() if series in busy or ends[series] >= watermark}
            ends = [end for series, end in ends.items() if series in last]
            if ends:
                self.handle.registerTimer(min(ends) + 1)
        if last:
            self.last.update(_pack(last))
        elif self.last.exists():
            self.last.clear()
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at : at + 10_000], columns=_OUTPUT.names)

    def _settle(self, series, waiting, recent, last, watermark, held, kept) -> list[tuple]:
        """What one series gives out; the rest goes to ``held`` and ``kept``, its newest old point to ``last``."""
        waiting.sort(key=_place)
        ready = [row for row in waiting if _millis(row) < watermark + self.correction]
        held += [(series, row) for row in waiting[len(ready) :]]
        before_all = last.get(series)
        # Points before the one handed over by a batch run belong to that run.
        ready = [row for row in ready if before_all is None or int(row[_TIME]) >= int(before_all[0])]
        given = {row[_ID]: (*joined, row[-1]) for row, joined in zip(recent, _joined(before_all, recent))}
        points = sorted([row[:-1] for row in recent] + ready, key=_place)
        joined = _joined(before_all, points)
        out, revised = [], []
        for point, before in zip(points, joined):
            known = given.get(point[_ID])
            revision = "0" if known is None else known[-1]
            if known is not None and known[:-1] != before:
                revision = str(int(revision) + 1)
            if known is None or revision != known[-1]:
                out.append((series, *point, *before, revision))
            revised.append((series, point, revision))
        # No point before the watermark can come any more: the newest of those is all that is needed of them.
        old = sum(_millis(point) < watermark for point in points)
        if old:
            last[series] = (*[points[old - 1][i] for i in _FIELDS], joined[old - 1][0])
        kept += revised[old:]
        return out

    def _put(self, state, names: dict, rows: list[tuple]) -> None:
        if not rows:
            state.clear()
            return
        chunks = [rows[at : at + 10_000] for at in range(0, len(rows), 10_000)]
        state.put([_pack([{series: names[series] for series in {row[0] for row in chunk}}, chunk]) for chunk in chunks])

    def _wake(self, millis: int) -> None:
        self.handle.registerTimer(max(1, millis + 1 - self.correction))

    def close(self) -> None:
        pass


def _joined(last: tuple | None, points: list[tuple]) -> list[tuple]:
    """For each of the sorted points whether it shares its time, and the fields of the point before it."""
    times = [point[_TIME] for point in points]
    before = last or (None,) * len(_LAST)
    out = []
    for number, point in enumerate(points):
        shared = times[number] in times[max(number - 1, 0) : number] + times[number + 1 : number + 2] or before[0] == times[number]
        shared = str(shared).lower()
        out.append((shared, *before))
        before = (*[point[i] for i in _FIELDS], shared)
    return out


def _place(row: tuple) -> tuple[int, int]:
    return int(row[_TIME]), int(row[_ID])


def _millis(row: tuple) -> int:
    return int(row[_TIME]) // 1_000_000


def _duration(text: str | None) -> int | None:
    """Milliseconds of a duration such as ``10 minutes``."""
    return None if text is None else int(pd.Timedelta(text).total_seconds() * 1000)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int").alias("bucket")


def _series() -> Column:
    return F.sha2(F.to_json(F.struct(*SERIES_IDENTITY)), 256).alias("series")


def last_points(points: DataFrame) -> DataFrame:
    """The newest point of each series of a batch, from which :func:`streaming_rate` can go on."""
    texts = [F.col(name).cast("string").alias(name) for name in POINT_FIELDS]
    newest = points.select(_series(), F.col("time_unix_nano").alias("_time"), "id", *texts)
    newest = newest.groupBy("series", "_time").agg(
        (F.count(F.lit(1)) > 1).cast("string").alias("same_time"), F.max_by(F.struct(*POINT_FIELDS), "id").alias("_point")
    )
    newest = newest.groupBy("series").agg(F.max_by(F.struct("_point.*", "same_time"), "_time").alias("_last"))
    return newest.select("series", "_last.*")


def streaming_rate(
    points: DataFrame,
    reorder_delay: str = "10 minutes",
    correction: str = "0 seconds",
    idle: str | None = None,
    initial: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rates of a stream of metric points, in append mode, with a ``revision`` that starts at 0.

    A point is rated ``reorder_delay`` after the newest one. For the period ``correction`` before that, late points are
    still taken, and what they change is given out again. A series without points for ``idle`` of event time leaves the
    state; its next point counts as its first. ``initial`` are :func:`last_points` of the rows before the stream. Series
    are dealt over ``buckets`` state keys, which a checkpoint fixes; more of them suit a stream of millions of series, as
    a micro-batch reads the buckets that it touches as a whole. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    texts = [F.col(name).cast("string").alias(name) for name in _CARRIED]
    happened = F.timestamp_micros(F.call_function("div", F.col("time_unix_nano"), F.lit(1000)))
    delay = _duration(reorder_delay) + _duration(correction)
    keyed = points.select(_series(), *texts, happened.alias("_happened")).withWatermark("_happened", f"{delay} milliseconds")
    keyed = keyed.select(_bucket(buckets), "*")
    ordered = keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=PreviousPoints(_duration(correction), _duration(idle)),
        outputStructType=_OUTPUT,
        outputMode="append",
        timeMode="eventTime",
        initialState=None if initial is None else initial.select(_bucket(buckets), "*").groupBy("bucket"),
    )
    types = {field.name: field.dataType for field in points.select(*_CARRIED).schema}
    columns = [F.col(name).cast(types[name]).alias(name) for name in _CARRIED]
    for name in ["same_time", *PREVIOUS_COLUMNS]:
        plain = name.removeprefix("previous_")
        kind = T.BooleanType() if name in _FLAGS else types[plain]
        columns.append(F.col(name).cast(kind).alias(name))
    return classify(ordered.select(*columns, F.col("revision").cast("int").alias("revision")))


def latest(rated: DataFrame) -> DataFrame:
    """The newest revision of each point of what a stream has written."""
    rest = [name for name in rated.columns if name != "id"]
    return rated.groupBy("id").agg(F.max_by(F.struct(*rest), "revision").alias("_row")).select("id", "_row.*")
