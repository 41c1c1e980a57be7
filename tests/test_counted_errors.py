"""Counts of errors need the answers beside their truth only once."""

import os

import pytest

from scorewright.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["g6_taxonomy_crosstab", "i6_low_confidence"])
def test_only_counted_rows_are_matched(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "counted-" in "".join(QUERIES[name](spark, DIR).inputFiles())
