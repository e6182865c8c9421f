"""Mergeable sketches of metric discovery, for ranges too long to count every series again.

One row per descriptor and receipt date holds exact totals and a HyperLogLog sketch of its series. Rows of any dates can be
merged, so a list over a year reads a year of sketch rows instead of its points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.model import METRIC_IDENTITY, NO_RECORDED_VALUE, SERIES_IDENTITY

SKETCH_BITS = 12  # 4,096 registers: a standard error of 1.04 / 64 = 1.6 %


def daily_sketches(points: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per metric descriptor and receipt date: totals, and ``series``, the sketch of its series.

    Null attributes count as a value of their own. Sketches are built before the exchange, so a descriptor with very many
    points reaches it as one row per partition.
    """
    received = F.timestamp_micros(F.call_function("div", F.col("received_at_unix_nano"), F.lit(1000)))
    null_marks = [F.col(name).isNull() for name in SERIES_IDENTITY]
    keyed = points.withColumns({"received_date": F.to_date(received), "_series": F.xxhash64(*SERIES_IDENTITY, *null_marks)})
    return keyed.groupBy(*METRIC_IDENTITY, "received_date").agg(
        F.hll_sketch_agg("_series", bits).alias("series"),
        F.count(F.lit(1)).alias("point_count"),
        F.count_if(F.col("flags").bitwiseAND(NO_RECORDED_VALUE) != 0).alias("no_recorded_value_count"),
        F.min("time_unix_nano").alias("first_time"),
        F.max("time_unix_nano").alias("last_time"),
        F.max("received_at_unix_nano").alias("last_received_at"),
    )


def metric_list_estimated(sketches: DataFrame) -> DataFrame:
    """One row per descriptor over all ``sketches``: exact totals and an estimated ``series_count``.

    Select dates before. Series seen on several dates count once, since sketches merge without counting twice.
    """
    return sketches.groupBy(*METRIC_IDENTITY).agg(
        F.hll_sketch_estimate(F.hll_union_agg("series")).alias("series_count"),
        F.sum("point_count").alias("point_count"),
        F.sum("no_recorded_value_count").alias("no_recorded_value_count"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("last_received_at").alias("last_received_at"),
    )
