"""Registered queries against their check SQL on the smallest data set."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SF_DIR = "/root/testdata/sf0.001"
SOME = (
    "path_flags", "primary_language", "component_list", "leak_findings", "debt_error_handling", "project_hygiene", "finding_counts",
    "versioned_dependencies", "stale_references", "reality_report", "gotchas", "check_results", "quota_admission",
    "suppressed_retries", "answered_from_cache", "vulnerabilities", "cleanup_plan", "stream_quota",
)
NAMES = tuple(entry.queries()) if os.environ.get("ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    count, message, _ = compare(spark, con, name, SF_DIR)
    assert message in ("", "rows only"), message
    assert count >= 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "project" and df.count() == 20


def test_every_check_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_is_covered():
    from corpuslens.plans import load_queries

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(os.path.join(root, "COVERAGE.md"), encoding="utf-8") as f:
        ids = re.findall(r"^\| ([A-Z]+\d+) \|", f.read(), re.M)
    covered = {i for c in load_queries().COVERS.values() for i in c}
    assert ids and set(ids) == covered
