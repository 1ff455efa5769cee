import os

import pytest

from tamarack.llm import registry

from ..differential import compare, views

SF = "/root/testdata/sf0.001"


def test_names_and_kinds():
    sql = registry.oracle_sql()
    assert set(sql) <= set(registry.queries()) and all(isinstance(v, str) for v in sql.values())
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, name):
    assert compare(spark, views(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""
