"""Readable columns: labels, messages, attribute text and safe cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.times import rfc3339_nano
from tracewell.model import SEVERITY_BANDS, SPAN_KINDS, SPAN_STATUSES
from tracewell.plans.catalog import SUMMARY_COLUMNS

# Output columns that hold a time, and those that hold JSON text.
TIME_COLUMNS = [
    "received_at",
    "time",
    "start_time",
    "end_time",
    "first_time",
    "last_time",
    "last_received_at",
    "interval_start",
    "interval_end",
    "observed_time",
]
JSON_COLUMNS = [
    "body",
    "payload",
    "resource_attributes",
    "scope_attributes",
    "attributes",
    "events",
    "links",
    "bucket_counts",
    "explicit_bounds",
    "positive",
    "negative",
    "quantile_values",
    "exemplars",
]
ATTRIBUTE_COLUMNS = ["attributes", "resource_attributes", "scope_attributes"]
CELL_LENGTH = 64

_ESCAPES = {"\n": r"\n", "\r": r"\r", "\t": r"\t"}


def label(code: Column, names: list[str]) -> Column:
    """Name of a code, or the code itself where it has none."""
    named = F.get(F.array(*[F.lit(name) for name in names]), code.cast("int"))
    return F.coalesce(F.when(code >= 0, named), code.cast("string"))


def severity_label(number: Column) -> Column:
    """Band of a severity number: four numbers to a band, from 1 to 24."""
    band = F.get(
        F.array(*[F.lit(name) for name in SEVERITY_BANDS]),
        F.floor((number - 1) / F.lit(4)).cast("int"),
    )
    return F.when(number.between(1, 24), band).otherwise(number.cast("string"))


def message(body: Column) -> Column:
    """Text of a plain string body; other bodies stay JSON."""
    return F.coalesce(F.get_json_object(body, "$.string"), body)


def attribute_text(attributes: Column) -> Column:
    """An attribute list as ``key=value, key=value``; strings keep their quotes."""
    entries = F.from_json(attributes, "array<struct<key: string, value: map<string, string>>>")
    raw = F.from_json(attributes, "array<struct<key: string, value: string>>")

    def pair(entry: Column, position: Column) -> Column:
        kind = F.get(F.map_keys(entry["value"]), 0)
        value = F.get(F.map_values(entry["value"]), 0)
        source = F.get(raw, position)["value"]
        # All but integers appear as they stand in the JSON text.
        inner = F.regexp_extract(source, r'(?s)^\{"\w+":(.*)\}$', 1)
        return F.concat(entry["key"], F.lit("="), F.when(kind == "intValue", value).otherwise(inner))

    return F.coalesce(F.array_join(F.transform(entries, pair), ", "), attributes)


def safe_cell(text: Column) -> Column:
    """Text with control characters and line separators escaped, so it stays on one line."""
    cell = text
    for character, escape in _ESCAPES.items():
        cell = F.replace(cell, F.lit(character), F.lit(escape))
    for code in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0), 0x2028, 0x2029]:
        cell = F.replace(cell, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # Most texts need no escape at all; one search decides.
    needs = text.rlike(r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]")
    return F.when(needs, cell).otherwise(text)


def shortened(text: Column, length: int = CELL_LENGTH) -> Column:
    """At most ``length`` characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(
        text
    )


def is_empty(column: Column, json: bool) -> Column:
    """True for missing values; in JSON text also null, empty strings, lists and objects."""
    if not json:
        return column.isNull() | (column.cast("string") == "")
    return column.isNull() | F.trim(column).rlike(r'^(\[\s*\]|\{\s*\}|null|""|)\z')


def formatted(view: DataFrame) -> DataFrame:
    """Times as RFC 3339 text and ``monotonic`` as boolean; all else as it is."""
    columns = []
    for field in view.schema:
        column = F.col(field.name)
        if field.name in TIME_COLUMNS and isinstance(field.dataType, T.LongType):
            column = rfc3339_nano(column).alias(field.name)
        elif field.name == "monotonic":
            column = (column != 0).alias(field.name)
        columns.append(column)
    return view.select(*columns)


def summary(view: DataFrame, name: str, compact: bool = True) -> DataFrame:
    """The short form of a built-in view as text cells."""
    chosen = formatted(view.select(*SUMMARY_COLUMNS[name]))
    cells = []
    for field in chosen.schema:
        column = F.col(field.name)
        if field.name in ("kind", "span_kind") and isinstance(field.dataType, T.IntegerType):
            text = label(column, SPAN_KINDS)
        elif field.name == "status_code":
            text = label(column, SPAN_STATUSES)
        elif field.name == "severity_number":
            text = severity_label(column)
        elif field.name == "body":
            text = message(column)
        elif field.name in ATTRIBUTE_COLUMNS:
            text = attribute_text(column)
        else:
            text = column.cast("string")
        cell = safe_cell(text)
        cells.append((shortened(cell) if compact else cell).alias(field.name))
    return chosen.select(*cells)
