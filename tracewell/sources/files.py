"""Small files and folders on whatever file system the store lives on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; empty if it does not exist."""
    target, files = _path(spark, path)
    if not files.exists(target):
        return []
    return [status.getPath().getName() for status in files.listStatus(target)]


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    target, files = _path(spark, pattern)
    return [status.getPath().toString() for status in files.globStatus(target) or []]


def delete(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    target, files = _path(spark, path)
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; fails if it exists, which makes the first of two writers win.

    The text is written aside and renamed, so a reader never meets half of it. On HDFS the rename is one step that
    refuses an existing name; a local file system checks first, which is enough for one machine. Object stores without
    such a rename need one writer at a time.
    """
    target, files = _path(spark, path)
    aside = target.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), options)
    except Exception:
        files.delete(aside, False)
        raise
