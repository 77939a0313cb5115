"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import compare

from lumenlake.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLE_SQL.get(name)) is None
