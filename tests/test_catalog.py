import pytest

from tests.oracle import assert_same
from textward.plans.catalog import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir):
    assert_same(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(name, spark, sf_dir):
    assert queries()[name](spark, sf_dir).count() > 0
