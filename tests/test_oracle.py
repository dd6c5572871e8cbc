"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query(spark, name):
    oracle.compare(spark, SF_DIR, name, spark_entry.queries()[name], spark_entry.oracle_sql()[name])


def test_entry(spark):
    rows = spark_entry.entry(spark)
    assert rows.columns == ["row_key", "text", "length"] and rows.count() == 200
