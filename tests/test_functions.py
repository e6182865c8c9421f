import pytest
from pyspark.sql import functions as F

from tracewell.functions import anyvalue, attributes
from tracewell.functions.times import parse_duration, parse_timestamp, rfc3339_nano
from tracewell.plans import present

SENSITIVE = [
    "authorization", "X-Authorization/authorization", "http.request.header.Set-Cookie", "db.PASSWORD", "apiKey",
    "api-key", "client_secret", "my_secret", "x.session-token", "refreshToken", " token ", "password/", "a:idToken",
    "user_api_key", "csrf.token", "_password_", "service/access.token",
]
HARMLESS = ["input_tokens", "gen_ai.usage.output_tokens", "tokenizer", "secretary", "", "...", "password.hint", "author", "password x"]


@pytest.mark.parametrize(
    "text,nanos",
    [("15m", 900 * 10**9), ("1h30m", 5400 * 10**9), ("100ms", 10**8), ("1.5s", 15 * 10**8), ("-2s", -2 * 10**9), ("0", 0), ("2us", 2000)],
)
def test_durations(text, nanos):
    assert parse_duration(text) == nanos


@pytest.mark.parametrize("text", ["", "5", "1d", "m", "1h 2m", "9999999h9999999h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_timestamps():
    assert parse_timestamp("2024-01-01T00:00:00Z") == 1704067200 * 10**9
    assert parse_timestamp("2024-01-01T01:00:00.123456789+01:00") == 1704067200 * 10**9 + 123456789
    with pytest.raises(ValueError):
        parse_timestamp("2024-01-01")


def test_rfc3339(spark):
    rows = [(0,), (1704067200 * 10**9,), (1704067200 * 10**9 + 120_000_000,), (2**63 - 1,), (1,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n bigint").select(rfc3339_nano(F.col("n"))).collect()]
    assert got == [
        None, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.12Z", "2262-04-11T23:47:16.854775807Z",
        "1970-01-01T00:00:00.000000001Z",
    ]


def test_sensitive_keys(spark):
    keys = SENSITIVE + HARMLESS
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.s for r in frame.select("k", attributes.is_sensitive(F.col("k")).alias("s")).collect()}
    assert {k for k, s in got.items() if s} == set(SENSITIVE)
    assert {k for k in keys if anyvalue.sensitive(k)} == set(SENSITIVE)


@pytest.mark.parametrize(
    "text,want",
    [
        ("a=b", ("a", "stringValue", "b")), ("a=200", ("a", "intValue", 200)), ('a="200"', ("a", "stringValue", "200")),
        ("a=2.0", ("a", "doubleValue", 2.0)), ("a=1e3", ("a", "doubleValue", 1000.0)), ("a=true", ("a", "boolValue", True)),
        ("a=NaN", ("a", "stringValue", "NaN")), ("a=", ("a", "stringValue", "")), ("a=b=c", ("a", "stringValue", "b=c")),
    ],
)
def test_filter_literals(text, want):
    assert attributes.parse_filter(text) == want


@pytest.mark.parametrize("text", ["a", "=b", "a=null", "a=[1]", "a={}", "a=9223372036854775808", "a=1e999", "a=" + "x" * 5000])
def test_bad_filters(text):
    with pytest.raises(ValueError):
        attributes.parse_filter(text)


def test_typed_match(spark):
    listed = '[{"key":"code","value":{"intValue":"200"}},{"key":"ok","value":{"boolValue":true}},{"key":"r","value":{"doubleValue":2}}]'
    frame = spark.createDataFrame([(listed,)], "a string")
    want = {"code=200": True, 'code="200"': False, "code=200.0": False, "ok=true": True, "r=2.0": True, "r=2": False, "x=1": False}
    row = frame.select(*[attributes.matches("a", f).alias(f"f{i}") for i, f in enumerate(want)]).first()
    assert list(row) == list(want.values())


def test_presentation(spark):
    row = spark.createDataFrame(
        [(
            '[{"key":"a","value":{"stringValue":"x\\"y"}},{"key":"n","value":{"intValue":"7"}},{"key":"d","value":{"doubleValue":1.5}}]',
            "a\nb\tc\rd\x01e f\x9f", "x" * 65, '{"string":"hi"}', '{"map":[]}',
        )],
        "attrs string, raw string, long string, body string, other string",
    ).select(
        present.attribute_text(F.col("attrs")), present.safe_cell(F.col("raw")), present.shortened(F.col("long")),
        present.message(F.col("body")), present.message(F.col("other")), present.severity_label(F.lit(24)),
        present.severity_label(F.lit(0)), present.label(F.lit(6), ["a"]),
    ).first()
    assert list(row) == [
        'a="x\\"y", n=7, d=1.5', "a\\nb\\tc\\rd\\u0001e\\u2028f\\u009f", "x" * 63 + "…", "hi", '{"map":[]}', "fatal", "0", "6",
    ]


def test_empty_fields(spark):
    values = ["", "null", '""', "[]", "[ ]", "{}", " { } ", None, "0", "false", "[0]", '{"a":1}']
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(present.is_empty(F.col("v"), json=True)).collect()]
    assert got == [True] * 8 + [False] * 4


def test_nested_values():
    value = {"kvlistValue": {"values": [
        {"key": "b", "value": {"arrayValue": {"values": [{"kvlistValue": {"values": [{"key": "token", "value": {"stringValue": "s"}}]}}]}}},
        {"key": "a", "value": {"intValue": 9007199254740993}},
    ]}}
    clean = anyvalue.redact(value)
    assert "REDACTED" in str(clean) and "'s'" not in str(clean)
    assert [e["key"] for e in anyvalue.ordered(clean)["kvlistValue"]["values"]] == ["a", "b"]
    tagged = anyvalue.tagged(clean)
    assert [e["key"] for e in tagged["map"]] == ["b", "a"]
    assert tagged["map"][1]["value"] == {"int": "9007199254740993"}


@pytest.mark.parametrize("levels,fine", [(16, True), (17, False)])
def test_depth(levels, fine):
    value = {"stringValue": "x"}
    for _ in range(levels):
        value = {"arrayValue": {"values": [value]}}
    if fine:
        anyvalue.check(value)
    else:
        with pytest.raises(anyvalue.Invalid):
            anyvalue.check(value)
