import pytest

from fragmill.llm.queries import llm_oracle_sql, llm_queries
from tests.parity import compare


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, want = compare(spark, "/root/testdata/sf0.01", llm_queries()[name], llm_oracle_sql()[name])
    assert got == want


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in llm_queries()] == list(range(1, 11))
