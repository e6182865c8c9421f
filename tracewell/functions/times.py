"""Plan-time parsing of durations and timestamps, and nanosecond formatting columns."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.model import MAX_NANOS

# Duration units in nanoseconds.
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}

_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")
_DURATION = re.compile(r"[+-]?(?:0|(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+)\Z")
_RFC3339 = re.compile(
    r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})\Z"
)


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration such as ``15m``, ``1h30m`` or ``-1.5s``."""
    if not _DURATION.match(text):
        raise ValueError(f"invalid duration {text!r}")
    total = sum(
        (Fraction(number.rstrip(".")) * UNIT_NANOS[unit] for number, unit in _PART.findall(text)),
        Fraction(0),
    )
    nanos = int(total)
    if nanos > MAX_NANOS:
        raise ValueError(f"duration out of range: {text!r}")
    return -nanos if text.startswith("-") else nanos


def parse_timestamp(text: str) -> int:
    """Unix nanoseconds of an RFC 3339 timestamp; fractions beyond nanoseconds are cut."""
    match = _RFC3339.match(text)
    if not match:
        raise ValueError(f"invalid RFC3339 timestamp {text!r}")
    day, clock, fraction, zone = match.groups()
    moment = datetime.fromisoformat(f"{day}T{clock}{'+00:00' if zone == 'Z' else zone}")
    whole = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    seconds = whole.days * 86_400 + whole.seconds
    return seconds * 1_000_000_000 + int((fraction or "0")[:9].ljust(9, "0"))


def rfc3339_nano(nanos: Column) -> Column:
    """UTC text of unix nanoseconds with trailing zeros trimmed; 0 is a missing time."""
    billion = F.lit(1_000_000_000).cast("bigint")
    seconds = F.call_function("div", nanos - F.pmod(nanos, billion), billion)
    fraction = F.rtrim(F.lpad(F.pmod(nanos, billion).cast("string"), 9, "0"), F.lit("0"))
    base = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(base, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))
    return F.when(nanos != 0, text)


def millis_between(start: Column, end: Column) -> Column:
    """Milliseconds as double; inputs are unix nanoseconds."""
    return (end - start).cast("double") / F.lit(1e6)


def receipt_date(nanos: Column) -> Column:
    """UTC date of unix nanoseconds, the partition column of stored tables."""
    day = F.lit(86_400_000_000_000).cast("bigint")
    return F.date_from_unix_date(F.call_function("div", nanos - F.pmod(nanos, day), day).cast("int"))
