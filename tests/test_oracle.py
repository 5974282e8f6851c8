"""Every query against DuckDB on the smallest tables, and fixed counts on the next size."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duckdb_over

# The training-data operators have tests of their own beside them.
THEIRS = {*entry.llm.queries(), "pipeline"} if entry.llm else set()
QUERIES = {k: v for k, v in entry.queries().items() if k not in THEIRS}
SQL = {k: v for k, v in entry.oracle_sql().items() if k not in THEIRS}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_over(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# Packets of the derived table that each detector reports, counted apart from this code.
COUNTS = {
    "suspicious_payload": 473,
    "size_zscore_alerts": 182,
    "syn_rate_windows": 101,
    "connection_rate_windows": 153,
    "port_scan_windows": 38,
    "detect_port_scan": 5392,
    "detect_syn_flood": 344,
    "detect_connection_flood": 434,
}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_counts(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() == COUNTS[name]
