"""Attribute lists: typed filters, string lookup, sensitive keys and resource ids.

An attribute list is the JSON text ``[{"key": k, "value": {"<kind>Value": v}}, ...]``. It is
a list, not a map: order and repeated keys are data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILTERS = 32
MAX_FILTER_BYTES = 4096

# Names that mark a credential as the last segment of a key, and those
# that mark it as the end of the whole key.
SENSITIVE_NAMES = [
    "authorization",
    "proxyauthorization",
    "cookie",
    "setcookie",
    "password",
    "passwd",
    "secret",
    "apikey",
    "clientsecret",
    "token",
    "accesstoken",
    "refreshtoken",
    "idtoken",
    "sessiontoken",
    "csrftoken",
]
SENSITIVE_ENDINGS = [
    "password",
    "passwd",
    "secret",
    "api_key",
    "access_token",
    "refresh_token",
    "id_token",
    "session_token",
    "csrf_token",
]

ATTRIBUTE_LIST = (
    "array<struct<key: string, value: struct<stringValue: string, boolValue: boolean,"
    " intValue: string, doubleValue: double>>>"
)


def parse_filter(text: str) -> tuple[str, str, str | bool | int | float]:
    """``KEY=VALUE`` as (key, value kind, typed literal).

    A JSON scalar keeps its type (``200`` is an integer, ``"200"`` a string); any other
    text is a string.
    """
    key, found, literal = text.partition("=")
    if not found or not key:
        raise ValueError("an attribute filter reads KEY=VALUE")
    if len(text.encode()) > MAX_FILTER_BYTES:
        raise ValueError(f"an attribute filter has at most {MAX_FILTER_BYTES} bytes")
    try:
        value = json.loads(literal, parse_constant=_not_json)
    except ValueError:
        return key, "stringValue", literal
    if isinstance(value, bool):
        return key, "boolValue", value
    if isinstance(value, str):
        return key, "stringValue", value
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError("the integer of an attribute filter needs more than 64 bits")
        return key, "intValue", value
    if isinstance(value, float):
        if value in (float("inf"), float("-inf")):
            raise ValueError("the number of an attribute filter is not finite")
        return key, "doubleValue", value
    raise ValueError("an attribute filter compares with a string, a number or a boolean")


def _not_json(name: str):
    raise ValueError(name)


def matches(column: str, text: str) -> Column:
    """True where the attribute list ``column`` has an entry that equals ``KEY=VALUE``.

    Value types must agree: the string ``200`` never matches the integer ``200``.
    """
    key, kind, literal = parse_filter(text)
    entries = F.from_json(column, ATTRIBUTE_LIST)

    def same(entry: Column) -> Column:
        value = entry["value"][kind]
        if kind == "intValue":
            value = value.try_cast("bigint")
        return F.coalesce((entry["key"] == key) & (value == F.lit(literal)), F.lit(False))

    found = F.coalesce(F.exists(entries, same), F.lit(False))
    # Only texts with the quoted key are parsed. A key that JSON may spell in several ways is not looked for.
    plain = key.isascii() and key.isprintable() and not set(key) & set('"\\/<>&\'=')
    return F.contains(F.col(column), F.lit(f'"{key}"')) & found if plain else found


def check_filter_count(resource: list[str], attribute: list[str]) -> None:
    if len(resource) + len(attribute) > MAX_FILTERS:
        raise ValueError(f"more than {MAX_FILTERS} filters on resources and attributes")


def _sensitive_pattern() -> str:
    space = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
    # In the last segment, hyphens and underscores do not count.
    names = "|".join("[-_]*".join(name) for name in SENSITIVE_NAMES)
    last_segment = rf"(?:^{space}|[./:])[-_]*(?:{names})[-_]*[./:]*"
    # At the end of the whole key, any separator stands for an underscore.
    ending = "[-._/:](?:" + "|".join(name.replace("_", "[-._/:]") for name in SENSITIVE_ENDINGS) + ")"
    return rf"(?:{last_segment}|{ending}){space}\z"


def is_sensitive(key: Column) -> Column:
    """True for keys that name a credential; ``input_tokens`` and the like are not."""
    return F.coalesce(F.lower(key).rlike(_sensitive_pattern()), F.lit(False))


def json_text(text: Column) -> Column:
    """A string as JSON text, quotes included."""
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def resource_id(attributes: Column, schema_url: Column) -> Column:
    """Short fingerprint of a resource for display and filtering; never a grouping key."""
    identity = F.concat(F.lit("["), json_text(attributes), F.lit(","), json_text(schema_url), F.lit("]"))
    return F.substring(F.sha2(identity, 256), 1, 32)
