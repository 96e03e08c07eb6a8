"""Every query against its SQL on the smallest tables."""

import pytest

from mapgauge.plans import queries as plans
from tests.helpers import same, views


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf, con, name):
    same(plans.QUERIES[name](spark, sf), con, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).where("p_type = 'all'").count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
