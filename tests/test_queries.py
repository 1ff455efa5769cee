"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tamarack.plans import queries as core

from .differential import compare, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


#: Queries that rightly find nothing in the smallest tables.
NO_ROWS: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_is_its_sql(spark, con, name):
    said = compare(spark, con, name, core.QUERIES[name], core.ORACLES[name], SF)
    assert not said or (name in NO_ROWS and said.endswith("no rows")), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
