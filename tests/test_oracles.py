"""Registered queries against DuckDB on the smallest tables; tools/check_oracles.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare
from workload import oracles, queries

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "metric_rate", "metric_list", "services", "services_scoped", "logs_attr_int", "spans_filtered", "trace_timeline",
    "exemplar_traces", "otlp_logs_ingest", "otlp_metrics_ingest", "span_accepted", "retention_size_batched", "activity",
    "sensitive_keys", "log_summary", "adhoc_sql", "stream_dedup",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_equals_oracle(spark, duck, name):
    result = compare(spark, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name], duck)
    assert result.startswith("ok"), result


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracles.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
