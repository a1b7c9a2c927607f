"""Every query that SQL can express gives what DuckDB gives."""

import pytest

from lodestone.plans import ORACLE_SQL, QUERIES
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
