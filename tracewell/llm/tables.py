"""Intermediate tables in the shared folder of the cluster, and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import work_folder
from tracewell.sources import files

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staging:
    """Written tables of one operator call; each cuts the lineage, so a lost executor costs one step at most."""

    def __init__(self, spark, purpose: str):
        self.spark = spark
        self.base = work_folder(spark, purpose)

    def write(self, frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``frame`` and read it back. Its shuffle files go once the table is complete."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            frame.write.parquet(f"{self.base}/{name}", compression=compression)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(frame.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            files.delete(self.spark, f"{self.base}/{name}")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row; equal rows have equal keys, null counts as a value."""
    parts = []
    for name in columns:
        column = quoted(name)
        parts += [column, column.isNull()]
    return F.xxhash64(*parts)
