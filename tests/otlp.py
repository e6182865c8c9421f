"""Small OTLP-JSON requests for tests."""

import json


def attribute(key, value):
    kinds = {bool: "boolValue", int: "intValue", float: "doubleValue", str: "stringValue"}
    if isinstance(value, dict):
        return {"key": key, "value": value}
    return {"key": key, "value": {kinds[type(value)]: value}}


def mapping(**values):
    return {"kvlistValue": {"values": [attribute(k, v) for k, v in values.items()]}}


def array(*values):
    return {"arrayValue": {"values": [attribute("", v)["value"] for v in values]}}


def log(body="hello", attributes=(), resource=(("service.name", "shop"),), **fields):
    value = body if isinstance(body, dict) else {"stringValue": body}
    record = {"body": value, "attributes": [attribute(*a) for a in attributes], **fields}
    return json.dumps(
        {
            "resourceLogs": [
                {
                    "resource": {"attributes": [attribute(*a) for a in resource]},
                    "scopeLogs": [{"logRecords": [record]}],
                }
            ]
        }
    )


def spans(*items):
    """Each item is (trace number, span number, name)."""
    records = [{"traceId": f"{t:032x}", "spanId": f"{s:016x}", "name": name} for t, s, name in items]
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": records}]}]})


def metric(name, kind, point, resource=(("service.name", "shop"),), **data):
    body = {"name": name, kind: {"dataPoints": [point], **data}}
    return json.dumps(
        {
            "resourceMetrics": [
                {
                    "resource": {"attributes": [attribute(*a) for a in resource]},
                    "scopeMetrics": [{"scope": {"name": "meter"}, "metrics": [body]}],
                }
            ]
        }
    )
