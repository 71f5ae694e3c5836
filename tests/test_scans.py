"""How often the audit family reads the given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from corpuslens.plans import audit_queries

SF_DIR = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", ["fleet_report", "audit_report", "reality_report", "fleet_summary", "claim_findings"])
def test_each_text_is_read_once(spark, monkeypatch, name):
    read = []
    plain = audit_queries.cut_lineage

    def written(df, label):
        read.append(scans(df))
        return plain(df, label)

    monkeypatch.setattr(audit_queries, "cut_lineage", written)
    df = entry.queries()[name](spark, SF_DIR)
    assert read == [1, 1]  # documents for the instruction documents, documents for the files
    assert all(SF_DIR not in f for f in df.inputFiles())  # all else comes from what was written
