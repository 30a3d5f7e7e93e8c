"""Every core query against its statement on the smallest tables."""

import pytest
from compare import canon

from quillon.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name in SQL:
        want = oracle(DATA).sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
