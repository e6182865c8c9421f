"""The previous row of each series, safe for series of any size.

One window per series finds it. A series that holds more than its share of all rows is cut
into time cells first, so that no task sorts it whole; the last row of each cell is then
handed to the next cell of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# A series is hot when it holds more than 1 / HOT_PARTS of all rows. By counting, fewer than
# HOT_PARTS series can be hot, which bounds the list of them that is sent to the tasks.
HOT_PARTS = 10_000
HOT_MIN_ROWS = 2_000_000
CELL_ROWS = 500_000

def with_previous(
    points: DataFrame,
    identity: Sequence[str],
    fields: Sequence[str],
    hot_parts: int = HOT_PARTS,
    hot_min_rows: int = HOT_MIN_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add ``same_time``, ``previous_same_time`` and ``previous_<field>`` for the fields.

    Series are told apart by ``identity`` and ordered by ``time_unix_nano``, then ``id``;
    ``fields`` must include the time. Rows whose time is 0 have no defined previous row in
    a hot series, but serve as previous rows themselves. Runs one aggregation over the series keys first to find hot series. ``hot_parts=0``
    skips it where the caller knows that there are none.
    """
    keyed = points.withColumn("_series", F.xxhash64(*identity))
    hot = _hot_series(keyed, hot_parts, hot_min_rows, cell_rows) if hot_parts else None
    if hot is None:
        windowed = _in_order(keyed, ["_series", *identity], fields)
        before, shared = F.col("_before"), _shared_before()
        return _with_columns(windowed, points.columns, fields, lambda name: before[name], shared)

    # One exchange serves the window and the join with the handed-over points.
    placed = (
        keyed.join(F.broadcast(hot), "_series", "left")
        .withColumn("_cell", _cell())
        .repartition("_series", "_cell")
    )
    windowed = _in_order(placed, ["_series", "_cell", *identity], fields)
    joined = windowed.join(_handed_over(windowed, identity, fields), ["_series", "_cell"], "left").withColumn(
        "_earlier",
        F.get(F.filter("_handed", lambda h: h["identity"].eqNullSafe(F.struct(*identity))), 0),
    )
    first = F.col("_before").isNull()
    return _with_columns(
        joined,
        points.columns,
        fields,
        lambda name: F.when(first, F.col(f"_earlier.last.{name}")).otherwise(F.col(f"_before.{name}")),
        F.when(first, F.col("_earlier.shared")).otherwise(_shared_before()),
    )


def _in_order(keyed: DataFrame, partition: list[str], fields: Sequence[str]) -> DataFrame:
    """The neighbours of each point in time order.

    Points of equal time are neighbours, so the time on either side tells whether a
    timestamp is shared; no second window per timestamp is needed.
    """
    ordered = Window.partitionBy(*partition).orderBy("time_unix_nano", "id")
    time = F.col("time_unix_nano")
    return keyed.select(
        "*",
        F.lag(F.struct(*fields)).over(ordered).alias("_before"),
        F.lag(time, 2).over(ordered).alias("_before2"),
        F.lead(time).over(ordered).alias("_after"),
    ).withColumn("same_time", _equal(F.col("_before.time_unix_nano"), time) | _equal(F.col("_after"), time))


def _shared_before() -> Column:
    return _equal(F.col("_before2"), F.col("_before.time_unix_nano"))


def _with_columns(
    frame: DataFrame, kept: list[str], fields: Sequence[str], previous, shared: Column
) -> DataFrame:
    return frame.select(
        *kept,
        "same_time",
        *[previous(name).alias(f"previous_{name}") for name in fields],
        shared.alias("previous_same_time"),
    )


def _equal(left: Column, right: Column) -> Column:
    return F.coalesce(left == right, F.lit(False))


def _hot_series(keyed: DataFrame, parts: int, min_rows: int, cell_rows: int) -> DataFrame | None:
    time = F.col("time_unix_nano")
    total = Observation()
    largest = (
        keyed.groupBy("_series")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(time > 0, time)).alias("low"),
            F.max(time).alias("high"),
        )
        .observe(total, F.sum("n").alias("rows"))
        .where(F.col("n") > min_rows)
        .orderBy(F.desc("n"))
        .limit(parts)
        .collect()
    )
    rows = []
    for series in largest:
        if series.n * parts > (total.get["rows"] or 0):
            pieces = -(-series.n // cell_rows)
            span = series.high - series.low if series.low is not None else 0
            rows.append((series._series, max(span // pieces, 1), pieces))
    if not rows:
        return None
    return keyed.sparkSession.createDataFrame(rows, "_series bigint, _width bigint, _pieces bigint")


def _cell() -> Column:
    time = F.col("time_unix_nano")
    # A missing time never needs a previous point of its own (its reason is fixed by the
    # point alone), so these rows may be spread by id below all real cells.
    spread = -1 - F.pmod(F.xxhash64("id"), F.col("_pieces"))
    return (
        F.when(F.col("_width").isNull(), F.lit(0).cast("bigint"))
        .when(time == 0, spread)
        .otherwise(F.call_function("div", time, F.col("_width")))
    )


def _handed_over(windowed: DataFrame, identity: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each cell of a hot series, the last point of the nearest earlier cell."""
    series = ["_series", *identity]
    last = windowed.where(F.col("_width").isNotNull() & F.col("_after").isNull()).select(
        *series,
        F.greatest("_cell", F.lit(-1).cast("bigint")).alias("_cell"),
        F.struct("time_unix_nano", "id").alias("_order"),
        F.struct(*fields).alias("_point"),
        "same_time",
    )
    per_cell = (
        last.repartition("_series")
        .groupBy(*series, "_cell")
        .agg(
            F.max_by("_point", "_order").alias("_point"),
            (F.bool_or("same_time") | (F.count(F.lit(1)) > 1)).alias("_dup"),
        )
    )
    along = Window.partitionBy(*series).orderBy("_cell")
    handed = per_cell.select(
        "_series",
        "_cell",
        F.struct(
            F.struct(*identity).alias("identity"),
            F.lag("_point").over(along).alias("last"),
            F.lag("_dup").over(along).alias("shared"),
        ).alias("_h"),
    )
    # More than one entry only where two hot series share a 64-bit hash.
    return handed.groupBy("_series", "_cell").agg(F.collect_list("_h").alias("_handed"))
