import pytest

from loamkit.llm.queries import oracle_sql, queries
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, sf, name):
    assert_same(queries()[name](spark, sf), connect(sf), oracle_sql()[name])
