"""Every registered query against its SQL twin in DuckDB, over the smallest tables."""

import pytest

from orrery.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, SF, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
