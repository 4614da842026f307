import pytest

from compare import assert_same, views
from cuelake.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name], con)


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
