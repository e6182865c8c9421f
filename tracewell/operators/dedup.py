"""Idempotent inserts: first copies, records not stored yet, and span conflicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import work_folder

SPAN_IDENTITY = ["trace_id", "span_id"]
BROADCAST_KEYS = 1_000_000  # at some 100 bytes per key, well below the broadcast limits


def first_copies(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the first in ``order``.

    An aggregate, not a window: copies are dropped before the exchange, so any number of
    them may share a key.
    """
    rest = [name for name in rows.columns if name not in key and name not in order]
    least = F.struct(*[name for name in order if name not in key])
    if _ordered(rows.select(*rest).schema):
        # The order need not travel a second time.
        first = F.min(F.struct(least.alias("order"), F.struct(*rest).alias("rest")) if rest else F.struct(least.alias("order")))
    else:
        first = F.min_by(F.struct(least.alias("order"), F.struct(*rest).alias("rest")), least)
    kept = rows.groupBy(*key).agg(first.alias("_row"))
    part = {name: f"_row.{'rest' if name in rest else 'order'}.{name}" for name in rows.columns if name not in key}
    return kept.select(*[F.col(part.get(name, name)).alias(name) for name in rows.columns])


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.StructType):
        return all(_ordered(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def already_stored(
    rows: DataFrame, stored: DataFrame, key: Sequence[str], row_count: int, columns: Sequence[str] = ()
) -> DataFrame:
    """Stored ``key`` and ``columns`` of the keys that occur in the batch ``rows``.

    A batch of known, modest size is broadcast, so the stored table is scanned but never
    shuffled; a larger batch takes a shuffled join. Either way no more than one row per
    key of the batch is left.
    """
    keys = rows.select(*key).distinct()
    if row_count <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return stored.select(*key, *columns).join(keys, list(key), "left_semi").dropDuplicates(list(key))


def unseen(rows: DataFrame, stored: DataFrame, key: Sequence[str], row_count: int) -> DataFrame:
    """Rows whose ``key`` is not in ``stored``."""
    return rows.join(already_stored(rows, stored, key, row_count), list(key), "left_anti")


def conflicting_identities(spans: DataFrame) -> DataFrame:
    """Identities that occur with more than one content, with the number of spans."""
    return (
        spans.groupBy(*SPAN_IDENTITY)
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.min("fingerprint").alias("_low"),
            F.max("fingerprint").alias("_high"),
        )
        .where(F.col("_low") != F.col("_high"))
        .drop("_low", "_high")
    )


def _packed(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the hexadecimal texts ``names`` as bytes, half as long where they are exchanged; other texts stay whole."""
    digits, other = (F.lit(bytearray([tag])) for tag in (0, 1))

    def pack(text: Column) -> Column:
        pairs = F.unhex(text)
        return F.when(F.lower(F.hex(pairs)) == text, F.concat(digits, pairs)).otherwise(F.concat(other, text.cast("binary")))

    return rows.withColumns({name: pack(F.col(name)) for name in names})


def _unpacked(rows: DataFrame, *names: str) -> DataFrame:
    """The texts that :func:`_packed` has packed."""

    def unpack(packed: Column) -> Column:
        rest = F.substr(packed, F.lit(2))
        return F.when(F.substr(packed, F.lit(1), F.lit(1)) == F.lit(bytearray([0])), F.lower(F.hex(rest))).otherwise(rest.cast("string"))

    return rows.withColumns({name: unpack(F.col(name)) for name in names})


def _digested(rows: DataFrame) -> DataFrame:
    """``rows`` with 128 bits of each fingerprint, which are enough to tell contents of one identity apart."""
    return rows.withColumn("fingerprint", F.unhex(F.md5(F.col("fingerprint").cast("binary"))))


def decide_spans(spans: DataFrame, stored: DataFrame, folder: str | None = None) -> DataFrame:
    """``request_key``, ``accepted`` for every request that touches a contested identity.

    Requests take effect in order of receipt, each as a whole: a request is refused if one
    of its spans exists with other content, stored or in an accepted earlier request.
    Requests not in the result are accepted. ``spans`` needs request_key,
    received_at_unix_nano, the identity and the fingerprint; ``stored`` the identity and
    fingerprint of stored spans, best reduced by :func:`already_stored`. Only contested
    identities take part, and each round settles at least the earliest open request. The steps write their tables
    below ``folder``, which the caller may delete once the result has been used.
    """
    return _decided(*[_digested(_packed(rows, *SPAN_IDENTITY, "fingerprint")) for rows in (spans, stored)], folder)


def _decided(spans: DataFrame, stored: DataFrame, folder: str | None) -> DataFrame:
    """As :func:`decide_spans`, of packed identities and digested fingerprints."""
    columns = ["fingerprint", "request_key", "received_at_unix_nano"]
    # The claims are dealt once: as it uses every column, the aggregate reads the same exchange as the join after it.
    claims = spans.select(*columns, *SPAN_IDENTITY).repartition(*SPAN_IDENTITY)
    held = stored.select(*SPAN_IDENTITY, F.col("fingerprint").alias("_held"))
    low, high = F.col("_low.fingerprint"), F.col("_high.fingerprint")
    identities = (
        claims.groupBy(*SPAN_IDENTITY)
        .agg(F.min(F.struct(*columns)).alias("_low"), F.max(F.struct(*columns)).alias("_high"))
        .join(held, SPAN_IDENTITY, "left")
        .where((low != high) | (F.col("_held") != low))
        .select(*SPAN_IDENTITY, "_held")
    )
    per_request = (
        claims.join(identities, SPAN_IDENTITY)
        .groupBy("request_key", "received_at_unix_nano", *SPAN_IDENTITY, "_held")
        .agg(F.min("fingerprint").alias("fingerprint"), F.max("fingerprint").alias("_other"))
    )
    clash = (F.col("fingerprint") != F.col("_other")) | F.coalesce(
        F.col("_held") != F.col("fingerprint"), F.lit(False)
    )
    spark, round_number = spans.sparkSession, 0
    folder = folder or work_folder(spark, "span-claims")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}", compression="zstd")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    order = F.struct("received_at_unix_nano", "request_key")
    contested = written(per_request.select("*", clash.alias("_clash")).drop("_other"), "claims-0")
    inner = contested.groupBy("request_key").agg(F.bool_or("_clash").alias("_clash")).where("_clash")
    settled = [written(inner.select("request_key", F.lit(False).alias("accepted")), "settled-0")]
    opened = contested.drop("_clash").join(settled[0], "request_key", "left_anti")
    # A round carries the claims of open requests only; what earlier ones have stored is in _held.
    while not opened.isEmpty():
        round_number += 1
        first = opened.where("_held IS NULL").groupBy(*SPAN_IDENTITY).agg(F.min_by("request_key", order).alias("_first"))
        same = F.col("_held") == F.col("fingerprint")
        mine = F.col("_held").isNull() & (F.col("_first") == F.col("request_key"))
        judged = (
            opened.join(first, SPAN_IDENTITY, "left")
            .groupBy("request_key")
            .agg(F.bool_or(~same).alias("_refused"), F.bool_and(F.coalesce(same, mine)).alias("_clear"))
        )
        accepted = F.when(F.coalesce("_refused", F.lit(False)), False).when(F.col("_clear"), True)
        verdicts = written(
            judged.select("request_key", accepted.alias("accepted")).where("accepted IS NOT NULL"), f"settled-{round_number}"
        )
        settled.append(verdicts)
        inserted = opened.join(verdicts.where("accepted"), "request_key", "left_semi")
        inserted = inserted.groupBy(*SPAN_IDENTITY).agg(F.min("fingerprint").alias("_new"))
        left = opened.join(verdicts, "request_key", "left_anti").join(inserted, SPAN_IDENTITY, "left")
        opened = written(left.withColumn("_held", F.coalesce("_held", "_new")).drop("_new"), f"claims-{round_number}")
    return reduce(DataFrame.unionByName, settled)


def accepted_spans(
    spans: DataFrame, stored: DataFrame, row_count: int, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new spans of accepted requests, keys of refused requests); both read tables below ``folder``."""
    # What the store holds of these identities is read once and used by every step.
    folder = folder or work_folder(spans.sparkSession, "span-conflicts")
    texts = [*SPAN_IDENTITY, "fingerprint"]
    spans, stored = _packed(spans, *texts), _digested(_packed(stored, *texts))
    held = already_stored(spans, stored, SPAN_IDENTITY, row_count, ["fingerprint"])
    held.write.parquet(f"{folder}/held", compression="zstd")
    held = spans.sparkSession.read.parquet(f"{folder}/held")
    status = _decided(_digested(spans), held, f"{folder}/rounds")
    refused = status.where(~F.col("accepted")).select("request_key")
    kept = spans.join(refused, "request_key", "left_anti")
    copies = first_copies(kept, SPAN_IDENTITY, ["received_at_unix_nano", "request_key", "position"])
    return _unpacked(copies.join(held, SPAN_IDENTITY, "left_anti"), *texts), refused
