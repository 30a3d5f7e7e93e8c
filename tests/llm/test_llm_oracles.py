"""The problems' queries against their statements on the smallest tables."""

import pytest
from compare import canon

from quillon.llm import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in SQL:
        want = oracle(DATA).sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
