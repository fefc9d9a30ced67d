"""All queries over the smallest tables, against their SQL where they have it."""

import functools

import pytest

import __spark_entry__
from cladeworks.jobs import catalogue
from tests.conftest import rows


@pytest.fixture(scope="module", autouse=True)
def shared():
    """The derived trees are parsed once for all tests."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalogue, "derived_trees", functools.cache(catalogue.derived_trees))
        yield


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(duck(catalogue.ORACLE_SQL[name], small))
