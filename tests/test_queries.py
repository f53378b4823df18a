"""Every registered query of the library against DuckDB."""

from __future__ import annotations

import pytest
from conftest import DATA, same

from leafwork.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    found = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLE_SQL:
        same(found, duck.execute(registry.ORACLE_SQL[name]))
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
