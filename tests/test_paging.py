"""Pages by rank: the rows of a sort, from one or two of its ranges."""

import random

import pytest
from pyspark.sql import functions as F

from seasonframe import lineage
from seasonframe.operators import paging

SCHEMA = "id long, score double, due int, name string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(k, None if rng.random() < 0.1 else float(rng.randrange(40)), None if rng.random() < 0.2 else rng.randrange(2000), f"n{k % 7}") for k in range(5000)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    return paging.build_rank_index(df, [F.asc_nulls_first("due"), F.asc("id")], str(tmp_path_factory.mktemp("rank")), range_rows=300, mark="due")


def in_order(rows):
    return [r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))]


def test_every_page(index, rows):
    want = in_order(rows)
    for page in (1, 2, 17, 50, 99, 100, 101):
        found = index.page(page, 50)
        assert (found.count, found.last_page) == (5000, 100)
        assert [r["id"] for r in found.rows.collect()] == want[(page - 1) * 50 : page * 50]
    assert [r["id"] for r in index.page(2, 1700).rows.collect()] == want[1700:3400]
    assert [r["id"] for r in index.page().rows.collect()] == want
    for wrong in (0, -3):
        with pytest.raises(ValueError, match="no page"):
            index.page(wrong, 50)
    with pytest.raises(ValueError, match="no page"):
        index.page(2)


def test_a_page_reads_two_ranges_at_most(index):
    assert len(index.ranges) >= 15
    for page in range(1, 101):
        assert 1 <= len(index.ranges_of((page - 1) * 50, 50)) <= 2
    plan = index.page(73, 50).rows._jdf.queryExecution().executedPlan().toString()
    files = index.page(73, 50).rows.inputFiles()
    assert "PartitionFilters" in plan and index.ranges_of(5000, 50) == []
    assert len({f.split("__range=")[1].split("/")[0] for f in index.rows.filter(F.col("__range").isin([index.ranges[k] for k in index.ranges_of(3600, 50)])).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) <= 2
    assert files


def test_midpoint(index, rows):
    for now in (-1, 0, 1, 700, 1999, 5000):
        past = sum(r[2] is not None and r[2] < now for r in rows)
        assert index.before(now) == past
        page = index.page("mid", 50, now=now)
        assert page.page == page.midpoint_page == 1 + past // 50
    with pytest.raises(ValueError, match="midpoint"):
        index.page("mid", 50)


def test_reopened_and_odd(spark, rows, tmp_path):
    """Descending with ties, the index read again; an empty table; names with dots; clashing names are the caller's."""
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("name", "a.name")
    folder = str(tmp_path / "rank")
    paging.build_rank_index(df, [F.desc_nulls_last("score"), F.asc("id")], folder, range_rows=1000)
    again = paging.open_rank_index(spark, folder)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    got = again.page(7, 333).rows
    assert [r["id"] for r in got.collect()] == want[1998:2331] and "a.name" in got.columns
    with pytest.raises(ValueError, match="no mark"):
        again.before(3)
    empty = paging.build_rank_index(df.limit(0), [F.asc("id")], str(tmp_path / "none"))
    assert empty.count == 0 and empty.page(1, 10).rows.collect() == [] and empty.page(1, 10).last_page == 0
    paging.drop_rank_index(spark, folder)
    assert not (tmp_path / "rank").exists()


def test_numbers_within_groups(spark):
    """Null groups and ties, a group that several ranges cut."""
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, 1, 2]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, v long").repartition(6)
    got = {r["v"]: r["n"] for r in lineage.number_within(df, ["g", "h"], [-F.col("v")], "n").collect()}
    seen = {}
    for g, h, v in sorted(rows, key=lambda r: -r[2]):
        seen[g, h] = seen.get((g, h), 0) + 1
        assert got[v] == seen[g, h]
    assert len(got) == 3000 and lineage.number_within(df.limit(0), ["g", "h"], [-F.col("v")], "n").collect() == []
