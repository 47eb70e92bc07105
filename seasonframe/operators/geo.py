"""Places: boxes, distances, clusters, nearby entities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import degrees_normalize, haversine_km


def box_condition(lat: Column, lon: Column, min_lat: float | None, max_lat: float | None, min_lon: float | None, max_lon: float | None) -> Column:
    """Strictly inside; a box whose west lies east of its east wraps around. True unless all four are given."""
    if None in (min_lat, max_lat, min_lon, max_lon):
        return F.lit(True)
    west, east = ((x + 180) % 360 - 180 for x in (min_lon, max_lon))
    across = (lon > west) & (lon < east) if west < east else (lon > west) | (lon < east)
    return (lat > min_lat) & (lat < max_lat) & across


def bbox(places: DataFrame, min_lat=None, max_lat=None, min_lon=None, max_lon=None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return places.filter(box_condition(F.col(lat), F.col(lon), min_lat, max_lat, min_lon, max_lon))


def nearby_places(places: DataFrame, ignore: str = "ignore_for_nearby_searches") -> DataFrame:
    return places.filter(~F.coalesce(F.col(ignore), F.lit(False)))


def places_in_view(places: DataFrame, limit: int | None = None, score: str = "score", name: str = "name", row_id: str = "id", **box) -> DataFrame:
    """The best places in a box: by score, name, id; a hundred at most."""
    return bbox(places, **box).orderBy(F.col(score).desc_nulls_last(), F.col(name).asc_nulls_first(), F.col(row_id).asc()).limit(min(limit or 100, 100))


def places_near(places: DataFrame, latitude: float, longitude: float, km: float | str, exact: bool = False, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Places around a point: a box in degrees that narrows to the pole, or with ``exact`` the great-circle distance."""
    try:
        km = float(km)
    except ValueError:
        return places.filter(F.lit(False))
    if exact:
        return places.filter(haversine_km(F.lit(latitude), F.lit(longitude), F.col(lat), F.col(lon)) <= km)
    d_lat = km * 360 / 40075
    d_lon = 0.0 if abs(latitude) >= 90 else d_lat * (90 - abs(latitude)) / 90
    return bbox(places, latitude - d_lat, latitude + d_lat, longitude - d_lon, longitude + d_lon, lat, lon)


def entities_near(entities: DataFrame, observations: DataFrame, near: DataFrame, place_id: str = "place_id", entity_id: str = "entity_id") -> DataFrame:
    """Entities observed at one of the places: two semi-joins, no list of ids."""
    seen = observations.filter(F.col(entity_id).isNotNull()).join(near.select(place_id), place_id, "left_semi").select(entity_id)
    return entities.join(seen, entity_id, "left_semi")


def geo_input(df: DataFrame, text: str, gazetteer: DataFrame, zip_: str = "zip", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``latitude``, ``longitude`` and ``geo_error`` of ``zip:NNN`` or ``lat,lon`` text."""
    value = F.col(text)
    is_zip = value.startswith("zip:")
    number = F.when(is_zip, F.substr(value, F.lit(5)).try_cast("long"))
    parts = F.split(value, ",")
    a, b = (F.trim(F.get(parts, F.lit(k))).try_cast("double") for k in (0, 1))
    known = gazetteer.select(F.col(zip_).cast("long").alias("__zip"), F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).dropDuplicates(["__zip"])
    error = (
        F.when(is_zip & number.isNull(), "zip didn't parse as a number")
        .when(is_zip & F.col("__lat").isNull(), "zip code not found")
        .when(~is_zip & (F.size(parts) != 2), "lat/lon wrong number of elements")
        .when(~is_zip & (a.isNull() | b.isNull()), "lat/lon didn't parse")
    )
    joined = df.withColumn("__asked", number).join(known, F.col("__asked") == F.col("__zip"), "left").withColumn("geo_error", error)
    fine = F.col("geo_error").isNull()
    return joined.withColumn("latitude", F.when(fine, F.when(is_zip, F.col("__lat")).otherwise(a))).withColumn("longitude", F.when(fine, F.when(is_zip, F.col("__lon")).otherwise(b))).drop("__asked", "__zip", "__lat", "__lon")


def grid_cluster(places: DataFrame, zoom: int, radius: int = 75, max_zoom: int = 20, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(cell_x, cell_y, n, lat, lon): points counted by cells of ``radius`` pixels of the Web-Mercator map at a zoom."""
    size = math.pow(2, min(zoom, max_zoom)) * 256 / radius
    limited = F.greatest(F.least(F.col(lat), F.lit(85.0511)), F.lit(-85.0511))
    x = F.floor((degrees_normalize(F.col(lon)) + 180) / 360 * size)
    y = F.floor((1 - F.log(F.tan(F.radians(limited)) + 1 / F.cos(F.radians(limited))) / math.pi) / 2 * size)
    return places.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(x.alias("cell_x"), y.alias("cell_y")).agg(F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def cluster_leaves(places: DataFrame, cell: tuple[int, int], zoom: int, page: int = 0, per_page: int = 5, row_id: str = "id", radius: int = 75, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A page of the points of one cell, by id."""
    size = math.pow(2, min(zoom, 20)) * 256 / radius
    limited = F.greatest(F.least(F.col(lat), F.lit(85.0511)), F.lit(-85.0511))
    x = F.floor((degrees_normalize(F.col(lon)) + 180) / 360 * size)
    y = F.floor((1 - F.log(F.tan(F.radians(limited)) + 1 / F.cos(F.radians(limited))) / math.pi) / 2 * size)
    return places.filter((x == cell[0]) & (y == cell[1])).orderBy(row_id).offset(page * per_page).limit(per_page)


def to_geojson(places: DataFrame, properties: list[str], lat: str = "lat", lon: str = "lon", output: str = "feature") -> DataFrame:
    """One GeoJSON feature a place, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return places.select("*", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))).alias(output))
