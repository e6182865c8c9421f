"""Counter rates over metric points, with a reason for every point that has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.model import NO_RECORDED_VALUE, SERIES_IDENTITY
from tracewell.operators.previous import with_previous

MAX_FINITE = 1.7976931348623157e308  # fixed value: largest finite double

POINT_FIELDS = ["time_unix_nano", "start_time_unix_nano", "number_int", "number_double", "flags"]
PREVIOUS_COLUMNS = [f"previous_{name}" for name in [*POINT_FIELDS, "same_time"]]


def counter_rate(points: DataFrame, identity: Sequence[str] = SERIES_IDENTITY, **skew) -> DataFrame:
    """``points`` with ``value``, interval, ``rate_per_second``, ``rate_reason``, ``gap_seconds``.

    All points of a series that the rate should see must be in ``points``: filter by
    name and time before, page after. ``value`` is a double; ``number_int`` keeps integers
    exact. ``skew`` goes to :func:`tracewell.operators.previous.with_previous`.
    """
    return classify(with_previous(points, identity, POINT_FIELDS, **skew))


def classify(points: DataFrame) -> DataFrame:
    """Rates and reasons from points that carry their previous point.

    Needs the point columns, ``same_time`` and the ``previous_*`` columns only, so batch
    and streaming share it.
    """
    time, start = F.col("time_unix_nano"), F.col("start_time_unix_nano")
    number = lambda prefix: F.coalesce(
        F.col(f"{prefix}number_int").cast("double"), F.col(f"{prefix}number_double")
    )
    both_int = F.col("number_int").isNotNull() & F.col("previous_number_int").isNotNull()
    value, previous_value = number(""), number("previous_")
    # Integers are compared and subtracted as integers: doubles lose them above 2^53.
    fell = F.when(both_int, F.col("number_int") < F.col("previous_number_int")).otherwise(
        value < previous_value
    )
    grown = F.when(
        both_int,
        F.coalesce(
            F.try_subtract("number_int", "previous_number_int").cast("double"), value - previous_value
        ),
    ).otherwise(value - previous_value)

    delta, cumulative = F.col("temporality") == "delta", F.col("temporality") == "cumulative"
    previous_time = F.col("previous_time_unix_nano")
    no_value = lambda flags: flags.bitwiseAND(NO_RECORDED_VALUE) != 0

    # The order of the rules decides: the first that holds names the reason.
    rules = [
        ("not_monotonic_sum", (F.col("metric_type") != "sum") | (F.col("monotonic") != 1)),
        ("unspecified_temporality", ~F.col("temporality").isin("delta", "cumulative")),
        ("no_recorded_value", no_value(F.col("flags"))),
        ("missing_or_nonfinite_value", value.isNull()),
        ("negative_monotonic_sum", value < 0),
        ("missing_timestamp", (time == 0) | (start == 0)),
        ("invalid_interval", start > time),
        ("ambiguous_timestamp", F.col("same_time")),
        ("zero_duration", start == time),
        ("overlapping_interval", delta & (previous_time > start)),
        ("no_baseline", cumulative & previous_time.isNull()),
        ("ambiguous_baseline", cumulative & F.col("previous_same_time")),
        (
            "no_baseline",
            cumulative
            & (previous_value.isNull() | (previous_value < 0) | no_value(F.col("previous_flags"))),
        ),
        ("reset", cumulative & (F.col("previous_start_time_unix_nano") != start)),
        ("invalid_baseline", cumulative & (previous_time < start)),
        ("counter_decreased", cumulative & fell),
    ]
    reason = F.when(rules[0][1], rules[0][0])
    for name, condition in rules[1:]:
        reason = reason.when(condition, name)

    usable = F.col("_reason").isNull()
    interval_start = F.when(usable, F.when(delta, start).otherwise(previous_time))
    increase = F.when(usable, F.when(delta, value).otherwise(grown))
    seconds = lambda nanos: nanos.cast("double") / F.lit(1e9)
    candidate = F.col("delta_value") / seconds(time - F.col("interval_start"))
    too_large = F.abs(F.col("_candidate")) > F.lit(MAX_FINITE)

    kept = [name for name in points.columns if name != "same_time" and name not in PREVIOUS_COLUMNS]
    return (
        points.withColumn("_reason", reason)
        .withColumns({"value": value, "interval_start": interval_start, "delta_value": increase})
        .withColumn("_candidate", candidate)
        .select(
            *kept,
            "value",
            "interval_start",
            time.alias("interval_end"),
            "delta_value",
            F.when(~too_large, F.col("_candidate")).alias("rate_per_second"),
            F.when(too_large, F.lit("nonfinite_rate")).otherwise(F.col("_reason")).alias("rate_reason"),
            F.when(
                delta & (previous_time > 0) & (start > previous_time), seconds(start - previous_time)
            ).alias("gap_seconds"),
        )
    )
