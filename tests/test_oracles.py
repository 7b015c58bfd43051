"""Queries against DuckDB on the smallest data folder.

The default run takes one query per family; ``SENTREL_ALL_QUERIES=1`` takes every key.
"""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "scan_table", "scan_corpus", "load_rules", "evidence_scan", "explode_lines", "path_features", "filter_paths",
    "redact", "project_finding", "strip_code", "pattern_scan_exclude", "code_event_scan", "dedupe_findings",
    "dep_requested_by", "audit_supply_chain", "functions_py", "functions_structural", "imports", "callers",
    "call_neighbourhood", "keep_imports", "code_slice", "label_sinks", "assignments", "taint_flows", "handler_windows",
    "auth_signals", "missing_authorization", "idor", "business_logic_report", "agent_rollup", "rule_lookup",
    "evidence_digest", "custom_rules", "stream_dedupe", "stream_severity", "audit_report",
)
KEYS = sorted(k for k in entry.oracle_sql() if not re.match(r"op\d+_", k)) if os.environ.get("SENTREL_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_equals_duckdb(spark, con, key):
    ok, note = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert ok, note


def test_every_key_has_a_statement():
    own = {key for key in entry.queries() if not re.match(r"op\d+_|pipeline$", key)}
    assert own <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
