"""Every registered query against its independent SQL."""

import pytest
from compare import difference, sql_result, type_differences

from __spark_entry__ import entry, oracle_sql, queries
from opinionloom.plans.queries import QUERIES
from oracle.sql import ORACLE


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, folder, name):
    result = QUERIES[name](spark, folder)
    expected, types = sql_result(folder, ORACLE[name])
    assert type_differences(result.dtypes, types) == {}
    assert difference(result.toPandas(), expected) is None


def test_entry(spark):
    assert entry(spark).count() > 0
