"""Every registered query against its SQL equivalent."""

import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
# These run block by block only on series longer than their limit.
LARGER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def connections():
    return {path: connect(path) for path in (SF, LARGER)}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_points.queries()) & set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connections, name):
    path = LARGER if "event" in name else SF
    assert differences(spark, connections[path], entry_points.queries()[name],
                       entry_points.oracle_sql()[name], path) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["k", "lag", "n", "f", "p"] and df.count() == 5
