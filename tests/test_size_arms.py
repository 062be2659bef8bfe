"""Sizes of both arms next to their SQL, on the smallest data."""
import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not mounted")
@pytest.mark.parametrize("name", ["size_metrics_arms", "size_summary_arms"])
def test_both_arms_equal_check(spark, name):
    df = entry.queries()[name](spark, SF)
    assert {r.arm for r in df.select("arm").distinct().collect()} == {"raw", "info"}
    state, note, _ = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note
