"""Every registered query against its oracle at the two smaller scales."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as contract
from parcella.plans import queries as plans

SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"
# The box and the look-ups of the fixtures hold no sale at the smallest scale.
QUERIES = {name: run for name, run in contract.queries().items() if name in plans.ALL}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in plans.ALL}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(name, spark, duck):
    assert not compare.differences(QUERIES[name](spark, SF), duck, ORACLE[name])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "year",
        "n_sales",
        "avg_price_eur",
        "median_price_eur",
        "min_price_eur",
        "max_price_eur",
    ]
    assert df.count() == 7


@pytest.mark.parametrize("name", ["derive_sales", "summary_stats", "trend_by_type", "flagged_sales"])
def test_smallest_scale(name, spark):
    con = compare.connect(SMALL)
    assert not compare.differences(QUERIES[name](spark, SMALL), con, ORACLE[name])
