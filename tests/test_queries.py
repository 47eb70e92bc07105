"""Every star-schema query against its SQL in DuckDB."""

import pytest

from seasonframe.plans import queries, source_queries  # noqa: F401
from seasonframe.plans.registry import ORACLES, QUERIES

from .oracle import connect, duckdb_rows, spark_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = spark_rows(df)
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        assert sorted(df.columns) == sorted(d[0] for d in result.description)
        assert rows == duckdb_rows(duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_prunes_columns(spark, sf_dir, capsys):
    QUERIES["consensus_offset"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    reads = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "l_shipdate" in line]
    assert reads and all("l_comment" not in r and "l_quantity" not in r for r in reads) and "CartesianProduct" not in plan
