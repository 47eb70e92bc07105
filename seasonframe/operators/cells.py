"""Places around many points at once, and clusters of places at every zoom: joins by cells of the globe.

At level a the globe has 2^a rows of equal height. A row has 2^b columns, b the most for which a column is as wide on the
ground as the row is high, at the row's narrower edge: one column at the poles, twice as many as rows at the
equator. Rows and columns are the leading bits of the two degrees, so that a level's cells lie within those of the
level before.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import degrees_normalize, haversine_km
from ..lineage import materialized, spread

MAX_LEVEL = 20
#: Levels by which the cells where points and places meet are finer than the boxes: few of the pairs tried are too far apart.
FINER = 3
#: Pairs that a task tries.
TASK_PAIRS = 20_000_000
#: Rows that a task holds on their way to meet.
TASK_ROWS = 2_000_000
#: Kilometres a degree of latitude has, a little less than it has.
KM_A_DEGREE = 111.1


def _two_to(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def _row(lat: Column, level: Column) -> Column:
    rows = _two_to(level)
    return F.least(F.greatest(F.floor((lat + 90) / 180 * rows), F.lit(0)), rows - 1)


def _column_bits(row: Column, level: Column) -> Column:
    """How many bits of longitude a row has."""
    height = 180 / _two_to(level)
    edge = F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90))
    narrow = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.when(edge >= 90, 0).otherwise(F.greatest(F.floor(F.log2(narrow) + level + 1), F.lit(0))).cast("int")


def _column(lon: Column, bits: Column) -> Column:
    """Of any longitude; beyond the date line it goes on counting."""
    return F.floor((lon + 180) / 360 * _two_to(bits))


def cell_of(lat: Column, lon: Column, level: Column) -> Column:
    """The cell of a point: (level, row, column)."""
    row = _row(lat, level)
    bits = _column_bits(row, level)
    column = F.pmod(_column(degrees_normalize(lon), bits), _two_to(bits))
    return F.struct(level.cast("int").alias("a"), row.cast("long").alias("r"), column.cast("long").alias("c"))


def cover_level(d_lat: Column) -> Column:
    """The finest level whose rows are as high as a box that reaches ``d_lat`` degrees either way."""
    return F.greatest(F.least(F.floor(F.log2(90 / F.greatest(d_lat, F.lit(1e-9)))), F.lit(MAX_LEVEL)), F.lit(0)).cast("int")


def cover(lat: Column, lon: Column, d_lat: Column, d_lon: Column, level: Column) -> Column:
    """All cells of a level that a box of degrees around a point meets; over a pole or the date line too.

    Two rows at most, and few columns of each, since a row's columns are as wide on the ground as it is high.
    """
    rows = F.sequence(_row(lat - d_lat, level), _row(lat + d_lat, level))

    def columns(row: Column) -> Column:
        bits = _column_bits(row, level)
        n = _two_to(bits)
        west, east = _column(lon - d_lon, bits), _column(lon + d_lon, bits)
        met = F.sequence(west, F.least(east, west + n - 1))
        return F.transform(met, lambda c: F.struct(level.cast("int").alias("a"), row.cast("long").alias("r"), F.pmod(c, n).cast("long").alias("c")))

    return F.array_distinct(F.flatten(F.transform(rows, columns)))


def circle_degrees(lat: Column, km: Column) -> tuple[Column, Column]:
    """How far a circle reaches in latitude and longitude; all the way round where it holds a pole."""
    d_lat = km / KM_A_DEGREE
    wide = F.sin(F.radians(d_lat)) / F.cos(F.radians(lat))
    whole = (F.abs(lat) + d_lat >= 90) | (wide >= 1)
    return d_lat, F.when(whole, 180.0).otherwise(F.degrees(F.asin(F.when(whole, 0.0).otherwise(wide))) + 1e-6)


def _reached(lat: Column, lon: Column, km: Column, cell: Column) -> Column:
    """Whether a circle may meet a cell: no spot of the cell is nearer than its least differences of degrees tell."""
    height, width = 180 / _two_to(cell["a"]), 360 / _two_to(_column_bits(cell["r"], cell["a"]))
    low = cell["r"] * height - 90
    up = F.greatest(F.abs(lat - low - height / 2) - height / 2, F.lit(0.0))
    across = F.greatest(F.abs(degrees_normalize(lon + 180 - (cell["c"] + 0.5) * width)) - width / 2, F.lit(0.0))
    narrow = F.greatest(F.least(F.cos(F.radians(low)), F.cos(F.radians(low + height))), F.lit(0.0))
    half = lambda degrees: F.pow(F.sin(F.radians(degrees / 2)), 2)
    return half(up) + F.cos(F.radians(lat)) * narrow * half(across) <= half(F.least(km / KM_A_DEGREE, F.lit(180.0))) + 1e-12


def _levelled(places: DataFrame, levels: list[int], lat: str, lon: str) -> DataFrame:
    """Places once for each level that is asked for."""
    return places.withColumn("__a", F.explode(F.array(*[F.lit(a) for a in levels]))).withColumn("__cell", cell_of(F.col(lat), F.col(lon), F.col("__a"))).drop("__a")


def _met(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of rows (``__cell``, ``__q``) and (``__cell``, ``__p``) of equal cells; both numbers must be fixed.

    Rows and pairs of all cells are counted. A cell of more than ``TASK_PAIRS`` pairs is cut into blocks, by the rows' numbers
    and not by what they hold, so that one spot with any number of rows is spread too. There are as many tasks as pairs ask for. A
    cut cell makes up so many pairs that the table of these cells, which all tasks get, is small beside the work.
    """
    side = math.isqrt(TASK_PAIRS)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = cells.select("__cell", one.alias("__nq"), none.alias("__np")).union(known.select("__cell", none.alias("__nq"), one.alias("__np")))
    load = materialized(both.groupBy("__cell").agg(F.sum("__nq").alias("__nq"), F.sum("__np").alias("__np")))
    pairs = F.col("__nq").cast("double") * F.col("__np")
    tried, rows = load.agg(F.coalesce(F.sum(pairs), F.lit(0.0)), F.coalesce(F.sum(F.col("__nq") + F.col("__np")), F.lit(0))).first()
    blocks = lambda n: F.ceil(F.col(n) / side).cast("int")
    heavy = F.broadcast(load.filter(pairs > TASK_PAIRS).select("__cell", blocks("__nq").alias("__nq"), blocks("__np").alias("__np")))

    def blocked(df: DataFrame, own: str, number: str, of_own: str, other: str, of_other: str) -> DataFrame:
        cut = df.join(heavy, "__cell", "left").withColumn(own, F.pmod(F.xxhash64(number), F.coalesce(of_own, F.lit(1))).cast("int"))
        return cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(of_other, F.lit(1)) - 1))).drop("__nq", "__np")

    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, math.ceil(tried / TASK_PAIRS), math.ceil(rows / TASK_ROWS))
    key = ["__cell", "__bq", "__bp"]
    one_side, other_side = blocked(cells, "__bq", "__q", "__nq", "__bp", "__np"), blocked(known, "__bp", "__p", "__np", "__bq", "__nq")
    return one_side.repartition(tasks, *key).join(other_side.repartition(tasks, *key), key)


def near_points(points: DataFrame, places: DataFrame, km: str = "km", exact: bool = True, lat: str = "lat", lon: str = "lon", place_lat: str = "lat", place_lon: str = "lon") -> DataFrame:
    """Pairs of points and places within the points' ``km``: (point, place, distance in km), both as structs.

    Points go to the cells that their circle meets, some dozens, places to their own; equal cells meet, and the distance
    decides. Cells of many rows are cut, so that no task tries many more than ``TASK_PAIRS`` pairs.
    ``exact``: the great circle; else the box in degrees that narrows to the pole, as ``geo.places_near`` takes it, whose
    edges don't count. The levels that the points ask for, 21 at most, come to the driver. A null or negative
    radius, or a null degree, finds nothing.
    """
    asked = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(km) >= 0)).select(F.struct(*points.columns).alias("point"), F.col(lat).cast("double").alias("__lat"), degrees_normalize(F.col(lon)).alias("__lon"), F.least(F.col(km).cast("double"), F.lit(20100.0)).alias("__km"))
    if exact:
        d_lat, d_lon = circle_degrees(F.col("__lat"), F.col("__km"))
    else:
        d_lat = F.col("__km") * 360 / 40075
        d_lon = F.when(F.abs("__lat") >= 90, 0.0).otherwise(d_lat * (90 - F.abs("__lat")) / 90)
    asked = asked.withColumn("__dlat", d_lat).withColumn("__dlon", F.least(d_lon, F.lit(180.0))).withColumn("__a", cover_level(F.col("__dlat")) + FINER)
    asked = materialized(spread(asked).withColumn("__q", F.monotonically_increasing_id()))
    levels = sorted(r[0] for r in asked.select("__a").distinct().collect())
    if not levels:
        levels = [0]
    cells = asked.withColumn("__cell", F.explode(cover(F.col("__lat"), F.col("__lon"), F.col("__dlat"), F.col("__dlon"), F.col("__a"))))
    if exact:
        cells = cells.filter(_reached(F.col("__lat"), F.col("__lon"), F.col("__km"), F.col("__cell")))
    there = places.select(F.struct(*places.columns).alias("place"), F.col(place_lat).cast("double").alias("__plat"), F.col(place_lon).cast("double").alias("__plon"))
    there = there.filter(F.col("__plat").isNotNull() & F.col("__plon").isNotNull() & ~F.isnan("__plat") & ~F.isnan("__plon"))
    there = materialized(spread(there).withColumn("__p", F.monotonically_increasing_id()))
    met = _met(cells, _levelled(there, levels, "__plat", "__plon")).withColumn("distance", haversine_km(F.col("__lat"), F.col("__lon"), F.col("__plat"), F.col("__plon")))
    if exact:
        inside = F.col("distance") <= F.col("__km")
    else:
        off = degrees_normalize(F.col("__plon") - F.col("__lon"))
        inside = (F.abs(F.col("__plat") - F.col("__lat")) < F.col("__dlat")) & (F.abs(off) < F.col("__dlon"))
    return met.filter(inside).select("point", "place", "distance")


# --- clusters


def _mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A spot on the map, a square of side 1."""
    limited = F.radians(F.greatest(F.least(lat, F.lit(85.0511)), F.lit(-85.0511)))
    return (degrees_normalize(lon) + 180) / 360, (1 - F.log(F.tan(limited) + 1 / F.cos(limited)) / math.pi) / 2


def _square(x: Column, y: Column, wide: int, i: int = 0, j: int = 0) -> Column:
    """One of ``wide`` x ``wide`` squares of the map, or a neighbour; the map's left and right edges meet."""
    column = F.least(F.floor(x * wide), F.lit(wide - 1)) + i
    return F.struct(F.pmod(column, F.lit(wide)).cast("long").alias("i"), (F.floor(y * wide) + j).cast("long").alias("j"))


def _neighbours(spots: DataFrame, radius: float) -> DataFrame:
    """(a, b, d, first) of spots (id, x, y, n) within the radius, both ways round; ``first``: b is before a as a seed."""
    wide = max(1, math.floor(1 / radius))
    around = F.array_distinct(F.array(*[_square(F.col("x"), F.col("y"), wide, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    one = spots.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("an"), F.explode(around).alias("cell"))
    two = spots.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("bn"), _square(F.col("x"), F.col("y"), wide).alias("cell"))
    across = F.abs(F.col("ax") - F.col("bx"))
    across = F.least(across, 1 - across)
    d = across * across + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    # by number of points; equals in an order that has nothing to do with where they lie
    rank = lambda n, k: F.struct(-F.col(n), F.xxhash64(k), F.col(k))
    return one.join(two, "cell").filter((F.col("a") != F.col("b")) & (d <= radius * radius)).select("a", "b", d.alias("d"), (rank("bn", "b") < rank("an", "a")).alias("first"))


def _seeded(spots: DataFrame, radius: float, max_rounds: int) -> DataFrame:
    """(id, seed): each spot's seed, itself if it is one.

    A spot that comes before all others within the radius is a seed and takes in those that are in no cluster yet; the
    nearest seed takes a spot, the least id among equals. This goes on until no two open spots are neighbours.
    """
    pairs = materialized(_neighbours(spots, radius))
    taken = None
    for _ in range(max_rounds):
        if pairs.isEmpty():
            rest = spots.select("id", F.col("id").alias("seed"))
            return rest if taken is None else taken.union(rest.join(taken.select("id"), "id", "left_anti"))
        seeds = pairs.groupBy("a").agg(F.bool_or("first").alias("blocked")).filter(~F.col("blocked")).select("a")
        inside = pairs.join(seeds.withColumnRenamed("a", "b"), "b", "left_semi").groupBy("a").agg(F.min(F.struct("d", "b")).alias("s"))
        new = materialized(seeds.select(F.col("a").alias("id"), F.col("a").alias("seed")).union(inside.select("a", "s.b")))
        taken = new if taken is None else taken.union(new)
        gone = new.select("id")
        pairs = materialized(pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    raise RuntimeError(f"clusters not found in {max_rounds} rounds")


def cluster_pyramid(places: DataFrame, row_id: str = "id", score: str = "score", radius: int = 75, max_zoom: int = 20, top: int = 5, lat: str = "lat", lon: str = "lon", max_rounds: int = 60) -> DataFrame:
    """(zoom, id, n, lat, lon, parent, best): the clusters of all zooms, each zoom's made from those of the next one.

    A cluster is named by the place that seeds it. Seeds are farther than ``radius`` pixels apart, and the seeds that a
    cluster takes in lie within that radius of its own; so each has few neighbours, whatever number of places there is.
    ``n``, ``lat`` and ``lon`` are the number of its places and their mean on the map; ``parent`` is the cluster that takes it in
    one zoom out, ``best`` the ids of its ``top`` best places by score, then id. Every place is in one cluster a zoom. Places in one square
    of a quarter of the radius at the last zoom are one to begin with, however many they are. Null ids and degrees are left
    out; a null score is the least.
    """
    x, y = _mercator(F.col(lat), F.col(lon))
    fine = places.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(row_id).isNotNull())
    spots = fine.select(F.col(row_id).cast("long").alias("id"), x.alias("x"), y.alias("y"), F.coalesce(-F.col(score).cast("double"), F.lit(math.inf)).alias("worse"))
    pixel = 1 / (256 * 2.0**max_zoom)
    spots = spots.withColumn("cell", _square(F.col("x"), F.col("y"), math.ceil(4 / (radius * pixel))))
    # sums are combined before the shuffle, and each task passes on the few best of a square
    ranked = spots.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("worse", "id"))).filter(F.col("k") <= top)
    best = ranked.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("worse", "id"))).alias("best"))
    sums = spots.groupBy("cell").agg(F.min(F.struct("id", "x", "y")).alias("p"), F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    level = materialized(sums.join(best, "cell").select("p.id", "p.x", "p.y", "n", "sx", "sy", "best"))
    zooms = []
    for zoom in range(max_zoom, -1, -1):
        joined = level.join(_seeded(level.select("id", "x", "y", "n"), radius * pixel * 2.0 ** (max_zoom - zoom), max_rounds), "id")
        # few go into one: all that do are nearer to each other than to others of their zoom
        merged = joined.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, top).alias("best"), F.collect_list("id").alias("parts"), F.max(F.when(F.col("id") == F.col("seed"), F.struct("x", "y"))).alias("p"))
        level = materialized(merged.select(F.col("seed").alias("id"), "p.x", "p.y", "n", "sx", "sy", "best", "parts"))
        zooms.append(level.withColumn("zoom", F.lit(zoom)))
        level = level.drop("parts")
    clusters = reduce(DataFrame.union, zooms)
    parents = clusters.filter(F.col("zoom") < max_zoom).select((F.col("zoom") + 1).alias("zoom"), F.col("id").alias("parent"), F.explode("parts").alias("id"))
    mean_lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * F.col("sy") / F.col("n")))))
    out = clusters.join(parents, ["zoom", "id"], "left")
    return out.select("zoom", "id", "n", mean_lat.alias("lat"), (F.col("sx") / F.col("n") * 360 - 180).alias("lon"), "parent", F.transform("best", lambda b: b["id"]).alias("best"))
