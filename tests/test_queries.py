"""Every registered query next to its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, FOLDER)
    assert ok, message


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["src", "dst", "pairs", "avg_days", "weight"] and not df.isEmpty()
