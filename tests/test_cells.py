"""Places around many points and clusters of all zooms, against loops over all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seasonframe.operators import cells, geo


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def spots(n, seed):
    """All over the globe, a third in one town, some at the poles and the date line."""
    rng = random.Random(seed)
    out = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(45.0 + rng.gauss(0, 0.05), 9.0 + rng.gauss(0, 0.05)) for _ in range(n // 2)]
    return out + [(90.0, 0.0), (90.0, 77.0), (-90.0, 10.0), (89.9, -170.0), (0.0, 180.0), (0.0, -180.0), (0.001, 179.999), (12.0, -179.999), (-89.5, 0.0), (0.0, 0.0)]


def test_near_many_points(spark):
    rng = random.Random(1)
    asked = [(k, *s, rng.choice([0.0, 0.5, 3.0, 40.0, 700.0, 4000.0, 11000.0, 30000.0])) for k, s in enumerate(spots(80, 2))]
    places = [(k, *s) for k, s in enumerate(spots(250, 3))]
    points = spark.createDataFrame(asked + [(900, None, 1.0, 5.0), (901, 1.0, 1.0, None), (902, 1.0, 1.0, -1.0)], "q long, lat double, lon double, km double")
    table = spark.createDataFrame(places + [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 1.0)], "p long, lat double, lon double")
    got = [(r["q"], r["p"]) for r in cells.near_points(points, table).select("point.q", "place.p").collect()]
    want = {(q, p) for q, a, b, r in asked for p, c, d in places if km(a, b, c, d) <= min(r, 20100.0) + 1e-9}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000
    boxes = {(r["q"], r["p"]) for r in cells.near_points(points, table, exact=False).select("point.q", "place.p").collect()}
    for q, a, b, r in asked[::9]:
        if r < 9000:
            mine = {x["p"] for x in geo.places_near(table, a, b, r).select("p").collect()}
            assert {p for k, p in boxes if k == q} == mine


def test_covers_are_small(spark):
    rows = [(lat, lon, r) for lat in (-90.0, -89.0, -60.0, 0.0, 33.3, 75.0, 89.9) for lon in (-180.0, 0.0, 179.9) for r in (0.1, 5.0, 300.0, 3000.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, km double")
    d_lat, d_lon = cells.circle_degrees(F.col("lat"), F.col("km"))
    n = df.select(F.size(cells.cover(F.col("lat"), F.col("lon"), d_lat, d_lon, cells.cover_level(d_lat))).alias("n"))
    assert n.agg(F.max("n")).first()[0] <= 16
    plan = cells.near_points(df, df.select("lat", "lon"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("exact", [True, False])
def test_one_spot_is_many_tasks(spark, monkeypatch, exact):
    monkeypatch.setattr(cells, "TASK_PAIRS", 2500, raising=False)
    points = spark.range(200).select(F.col("id").alias("q"), F.lit(-89.9).alias("lat"), F.lit(7.0).alias("lon"), F.lit(900.0).alias("km"))
    places = spark.range(300).select(F.col("id").alias("p"), F.lit(-89.9).alias("lat"), F.lit(7.0).alias("lon"))
    found = cells.near_points(points, places, exact=exact).select("point.q", "place.p", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 60_000 == len({(r["q"], r["p"]) for r in found})
    # before, all were made by one task
    assert max(Counter(r["task"] for r in found).values()) < 15_000


def test_pairs_tried_near_the_pole(spark):
    """Cells as high as a circle is wide had all around the pole meet in one."""
    points = spark.createDataFrame([(k, -80.0 + k % 7, k * 13.0 % 360, 300.0) for k in range(100)], "q long, lat double, lon double, km double")
    places = spark.createDataFrame([(k, -80.0 + k % 9, k * 7.0 % 360) for k in range(400)], "p long, lat double, lon double")
    found = cells.near_points(points, places)
    level = cells.cover_level(F.col("dlat")) + cells.FINER
    d_lat, d_lon = cells.circle_degrees(F.col("lat"), F.col("km"))
    asked = points.withColumn("dlat", d_lat).withColumn("dlon", d_lon).withColumn("a", level).withColumn("cell", F.explode(cells.cover(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon"), F.col("a"))))
    asked = asked.filter(cells._reached(F.col("lat"), F.col("lon"), F.col("km"), F.col("cell")))
    tried = asked.select("cell", "a").join(places.crossJoin(asked.select("a").distinct()).select(cells.cell_of(F.col("lat"), F.col("lon"), F.col("a")).alias("cell")), "cell").count()
    assert found.count() <= tried <= 2.5 * found.count()


def test_pyramid(spark):
    places = [(k, *s, float(k % 50)) for k, s in enumerate(spots(120, 5))]
    df = spark.createDataFrame(places + [(None, 1.0, 1.0, 1.0), (999, None, 1.0, 1.0)], "id long, lat double, lon double, score double")
    radius, top = 75, 3
    rows = cells.cluster_pyramid(df, radius=radius, max_zoom=5, top=top).collect()
    where = {k: ((lon + 180) % 360 / 360, (1 - math.log(math.tan(t := math.radians(max(-85.0511, min(85.0511, lat)))) + 1 / math.cos(t)) / math.pi) / 2) for k, lat, lon, _ in places}
    score = {k: s for k, _, _, s in places}

    def apart(a, b):
        x = abs(where[a][0] - where[b][0])
        return math.hypot(min(x, 1 - x), where[a][1] - where[b][1])

    zooms = {z: {r["id"]: r for r in rows if r["zoom"] == z} for z in range(6)}
    for z, clusters in zooms.items():
        reach = radius / (256 * 2**z)
        assert sum(r["n"] for r in clusters.values()) == len(places)
        ids = sorted(clusters)
        assert all(apart(a, b) > reach - 1e-12 for k, a in enumerate(ids) for b in ids[:k])
        for r in clusters.values():
            assert len(r["best"]) == min(top, r["n"])
            if z:
                assert apart(r["id"], r["parent"]) <= reach * 2 + 1e-12 and r["parent"] in zooms[z - 1]
                assert zooms[z - 1][r["parent"]]["n"] >= r["n"]
            else:
                assert r["parent"] is None
    # the best of a cluster are the best of its parts
    for r in zooms[4].values():
        parts = [x for x in zooms[5].values() if x["parent"] == r["id"]]
        assert r["best"] == sorted({b for x in parts for b in x["best"]}, key=lambda k: (-score[k], k))[:top] and r["n"] == sum(x["n"] for x in parts)
    assert cells.cluster_pyramid(df.limit(0), max_zoom=2).collect() == []
