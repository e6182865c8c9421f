import random

import pytest

from tracewell.model import SERIES_IDENTITY
from tracewell.operators.rate import counter_rate

SECOND = 10**9
BASE = 1_700_000_000 * SECOND

SCHEMA = (
    "id bigint, received_at_unix_nano bigint, "
    + ", ".join(f"{n} {'int' if n == 'monotonic' else 'string'}" for n in SERIES_IDENTITY)
    + ", number_int bigint, number_double double, flags bigint, time_unix_nano bigint, start_time_unix_nano bigint, description string"
)


def point(name, number, start, end, value, temporality="cumulative", monotonic=1, flags=0, kind="sum", **identity):
    values = dict.fromkeys(SERIES_IDENTITY, "") | {
        "metric_name": name, "metric_type": kind, "temporality": temporality, "monotonic": monotonic, **identity,
    }
    at = lambda s: 0 if s is None else BASE + s * SECOND
    return (
        number, 0, *[values[n] for n in SERIES_IDENTITY],
        value if isinstance(value, int) else None, value if isinstance(value, float) else None,
        flags, at(end), at(start), identity.get("description", ""),
    )


# name: (points as (start, end, value, extras), rates newest first, reasons newest first)
CASES = {
    "cumulative": ([(0, 10, 100), (0, 20, 130)], [3.0, None], [None, "no_baseline"]),
    "reset": ([(0, 10, 100), (11, 20, 2), (11, 30, 22)], [2.0, None, None], [None, "reset", "no_baseline"]),
    "unknown_start": ([(10, 10, 100), (10, 20, 120)], [2.0, None], [None, "zero_duration"]),
    "decrease": ([(0, 10, 100), (0, 20, 2)], [None, None], ["counter_decreased", "no_baseline"]),
    "absent": ([(0, 10, 100, {"flags": 1}), (0, 20, 120)], [None, None], ["no_baseline", "no_recorded_value"]),
    "duplicate_time": (
        [(0, 10, 100), (0, 10, 110), (0, 20, 120)], [None] * 3,
        ["ambiguous_baseline", "ambiguous_timestamp", "ambiguous_timestamp"],
    ),
    "delta": ([(0, 10, 20, {"temporality": "delta"}), (15, 20, 20, {"temporality": "delta"})], [4.0, 2.0], [None, None]),
    "overlap": (
        [(0, 10, 20, {"temporality": "delta"}), (5, 20, 30, {"temporality": "delta"})],
        [None, 2.0], ["overlapping_interval", None],
    ),
    "nonmonotonic": ([(0, 10, 20, {"monotonic": 0})], [None], ["not_monotonic_sum"]),
    "gauge": ([(0, 10, 20, {"monotonic": None, "kind": "gauge"})], [None], ["not_monotonic_sum"]),
    "unspecified": ([(0, 10, 20, {"temporality": "unspecified"})], [None], ["unspecified_temporality"]),
    "missing_start": ([(None, 10, 20, {"temporality": "delta"})], [None], ["missing_timestamp"]),
    "big_integers": ([(0, 10, 9007199254740992), (0, 20, 9007199254741012)], [2.0, None], [None, "no_baseline"]),
    "big_decrease": ([(0, 10, 9007199254740993), (0, 20, 9007199254740992)], [None, None], ["counter_decreased", "no_baseline"]),
    "mixed_numbers": ([(0, 10, 10), (0, 20, 30.0)], [2.0, None], [None, "no_baseline"]),
    "description": ([(0, 10, 10, {"description": "one"}), (0, 20, 30, {"description": "two"})], [2.0, None], [None, "no_baseline"]),
    "resource": ([(0, 10, 10, {"resource_attributes": "1"}), (0, 20, 30, {"resource_attributes": "2"})], [None] * 2, ["no_baseline"] * 2),
    "scope": ([(0, 10, 10, {"scope_version": "1"}), (0, 20, 30, {"scope_version": "2"})], [None] * 2, ["no_baseline"] * 2),
    "attribute": ([(0, 10, 10, {"attributes": "1"}), (0, 20, 30, {"attributes": "2"})], [None] * 2, ["no_baseline"] * 2),
    "unit": ([(0, 10, 10, {"unit": "s"}), (0, 20, 30, {"unit": "ms"})], [None] * 2, ["no_baseline"] * 2),
    "invalid_interval": ([(11, 10, 10)], [None], ["invalid_interval"]),
    "invalid_baseline": ([(20, 10, 10), (20, 30, 30)], [None, None], ["invalid_baseline", "invalid_interval"]),
    "negative": ([(0, 10, -1)], [None], ["negative_monotonic_sum"]),
    "no_value": ([(0, 10, None)], [None], ["missing_or_nonfinite_value"]),
    # The point without a time is still the baseline of the next one.
    "missing_time": ([(0, None, 5), (0, 20, 30)], [None, None], ["invalid_baseline", "missing_timestamp"]),
}


def _frame(spark):
    rows, number = [], 0
    for name, (points, _, _) in CASES.items():
        for start, end, value, *extras in points:
            number += 1
            rows.append(point(name, number, start, end, value, **(extras[0] if extras else {})))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("skew", [{}, {"hot_parts": 0}, {"hot_parts": 10**5, "hot_min_rows": 0, "cell_rows": 1}])
def test_golden_cases(spark, skew):
    got = {}
    for row in counter_rate(_frame(spark), **skew).collect():
        got.setdefault(row.metric_name, []).append(row)
    for name, (points, rates, reasons) in CASES.items():
        rows = sorted(got[name], key=lambda r: (-r.time_unix_nano, -r.id))
        assert [r.rate_per_second for r in rows] == rates, name
        assert [r.rate_reason for r in rows] == reasons, name
    newest = max(got["delta"], key=lambda r: r.time_unix_nano)
    assert newest.gap_seconds == 5.0


def test_overflow(spark):
    rows = [
        point("o", 1, 0, 10, 0.0, "delta"),
        (2, 0, *point("o", 2, 0, 10, 1.0, "delta")[2:-6], None, 1.7e308, 0, BASE + 20 * SECOND, BASE + 20 * SECOND - 1, ""),
    ]
    by_id = {r.id: r for r in counter_rate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by_id[2].rate_per_second is None and by_id[2].rate_reason == "nonfinite_rate"


def test_hot_series_equals_plain_window(spark):
    random.seed(5)
    rows = []
    for number in range(600):
        name = random.choice(["hot", "hot", "hot", "cold1", "cold2"])
        start = random.choice([0, 0, 0, 30, None])
        end = random.choice([None, *range(1, 200)])
        value = random.choice([None, number, float(number), -1])
        temporality = "delta" if name == "cold2" else "cumulative"
        rows.append(point(name, number, start, end, value, temporality, flags=random.choice([0, 0, 0, 1])))
    frame = spark.createDataFrame(rows, SCHEMA)
    columns = ["id", "value", "interval_start", "delta_value", "rate_per_second", "rate_reason", "gap_seconds"]

    def result(**skew):
        return sorted(map(tuple, counter_rate(frame, **skew).select(*columns).collect()), key=lambda r: r[0])

    plain = result(hot_parts=0)
    assert result(hot_parts=10**5, hot_min_rows=0, cell_rows=7) == plain
    assert result(hot_parts=3, hot_min_rows=10, cell_rows=25) == plain


def _stream(spark, folder, batches, **periods):
    """What a stream writes for batches of (id, series, minute, value), one file a micro-batch."""
    from tracewell.model import METRICS, TABLE_SCHEMAS
    from tracewell.streaming.rate import streaming_rate

    schema = TABLE_SCHEMAS[METRICS]
    for batch in batches:
        _points(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rated = streaming_rate(stream, "10 minutes", **periods)
    writer = rated.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rated.schema).parquet(f"{folder}/out")


def _points(spark, rows):
    from pyspark.sql import functions as F

    from tracewell.model import METRICS, TABLE_SCHEMAS

    made = spark.createDataFrame(rows, "id long, metric_name string, minute long, number_int long")
    given = {
        "time_unix_nano": (F.lit(1_700_000_000) + F.col("minute") * 60) * 10**9, "start_time_unix_nano": F.lit(1_600_000_000 * 10**9),
        "metric_type": F.lit("sum"), "monotonic": F.lit(1), "temporality": F.lit("cumulative"), "flags": F.lit(0),
        "received_at_unix_nano": F.lit(1),
    }
    columns = []
    for field in TABLE_SCHEMAS[METRICS]:
        value = F.col(field.name) if field.name in made.columns else given.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return made.select(columns)


def _seen(rated):
    return sorted((r.id, r.revision, r.delta_value, r.rate_reason) for r in rated.where("metric_name = 'a'").collect())


BATCHES = [
    [(1, "a", 0, 10), (2, "a", 20, 50)],
    [(9, "other", 60, 0)],
    [(9, "other", 61, 0)],
    [(3, "a", 10, 30), (4, "a", 70, 90)],
    [(9, "other", 600, 0)],
]


def test_late_points_correct_their_neighbours(spark, folder):
    from tracewell.streaming.rate import latest

    rated = _stream(spark, folder, BATCHES, correction="2 hours")
    assert _seen(rated) == [
        (1, 0, None, "no_baseline"), (2, 0, 40.0, None), (2, 1, 20.0, None), (3, 0, 20.0, None), (4, 0, 40.0, None)
    ]
    assert [row[:2] for row in _seen(latest(rated))] == [(1, 0), (2, 1), (3, 0), (4, 0)]


def test_without_correction_late_points_are_left_to_the_batch(spark, folder):
    assert [row[:2] for row in _seen(_stream(spark, folder, BATCHES))] == [(1, 0), (2, 0), (4, 0)]


def test_stream_goes_on_from_a_batch(spark, folder):
    from tracewell.streaming.rate import last_points

    before = _points(spark, [(7, "a", -30, 3), (8, "a", -20, 4), (6, "b", -20, 4)])
    rated = _stream(spark, folder, BATCHES, correction="2 hours", initial=last_points(before))
    assert _seen(rated)[0] == (1, 0, 6.0, None)


def test_idle_series_leave_the_state(spark, folder):
    batches = [[(1, "a", 0, 10)], [(9, "other", 300, 0)], [(9, "other", 400, 0)], [(2, "a", 500, 50)], [(9, "other", 900, 0)]]
    assert _seen(_stream(spark, folder, batches, idle="1 hour")) == [(1, 0, None, "no_baseline"), (2, 0, None, "no_baseline")]


def test_state_holds_few_packed_values():
    """200 series of 5 points take one value of state, not one a point, and a second timer of a micro-batch gives nothing."""
    import pandas as pd

    from tracewell.model import SERIES_IDENTITY
    from tracewell.operators.rate import POINT_FIELDS
    from tracewell.streaming.rate import PreviousPoints

    class State:
        def __init__(self):
            self.values = []

        def get(self):
            return iter(self.values) if self.many else self.values[-1]

        def put(self, rows):
            self.values = list(rows)

        def appendValue(self, row):
            self.values.append(row)

        def appendList(self, rows):
            self.values.extend(rows)

        def update(self, row):
            self.values = [row]

        def exists(self):
            return bool(self.values)

        def clear(self):
            self.values = []

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def _state(self, name, many):
            self.states[name] = State()
            self.states[name].many = many
            return self.states[name]

        def getListState(self, name, schema):
            return self._state(name, True)

        def getValueState(self, name, schema):
            return self._state(name, False)

        def registerTimer(self, millis):
            self.timers.append(millis)

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 10**9

    rows = []
    for n in range(1000):
        row = dict.fromkeys([*SERIES_IDENTITY, *POINT_FIELDS, "received_at_unix_nano"], None)
        rows.append(row | {"series": f"s{n % 200}", "id": str(n), "time_unix_nano": str(n * 10**9), "number_int": str(n)})
    handle, processor = Handle(), PreviousPoints()
    processor.init(handle)
    assert list(processor.handleInputRows((1,), iter([pd.DataFrame(rows)]), Watermark())) == []
    assert len(handle.states["waiting"].values) == 1 and len(handle.timers) == 1
    out = pd.concat(processor.handleExpiredTimer((1,), Watermark(), None))
    assert len(out) == 1000 and out["previous_number_int"].isna().sum() == 200
    follows = out[out["previous_number_int"].notna()]
    assert (follows["id"].astype(int) - follows["previous_number_int"].astype(int) == 200).all()
    assert list(processor.handleExpiredTimer((1,), Watermark(), None)) == []
    assert not handle.states["waiting"].values and len(handle.states["last"].values) == 1
