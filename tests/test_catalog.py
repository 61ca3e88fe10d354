"""Every registered query against its DuckDB SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.duckdb_sql import SQL
from catalog.spark_queries import QUERIES
from tests.oracle import difference


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(spark, sf_dir, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
