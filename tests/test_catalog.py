import pytest

import __spark_entry__ as entry
from fragmill.plans.catalog import ORACLES, QUERIES
from tests.parity import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got, want = compare(spark, SF, QUERIES[name], ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_harness_sees_a_difference(spark):
    got, want = compare(spark, SF, QUERIES["q27_release_counts"], ORACLES["q27_release_counts"].replace("count(*) AS files", "count(*) + 1 AS files"))
    assert got != want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
