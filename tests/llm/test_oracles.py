"""Text queries that SQL can express, against DuckDB."""

import pytest

from seasonframe.llm.queries import ORACLES, QUERIES

from ..oracle import connect, duckdb_rows, spark_rows


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duckdb_rows(connect(sf_dir), ORACLES[name])
